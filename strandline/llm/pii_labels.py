"""Personal data by weak supervision, with DataFrame functions alone.

Regular expressions find spans of fixed form (the base kinds, which always count) and looser candidates. Labelers of three
sorts vote on every span: its form and checks, gazetteers, and the words around it. Expectation-maximisation estimates how
often each labeler votes on true and on false spans; the posterior of each vote pattern then is the soft label from which a
logistic span classifier is trained, whose inputs are the votes and the span's shape. A candidate that the classifier
accepts is added to the base spans. For kinds without a checksum the check is that the words before, or a gazetteer, say what they are.

Everything that is fitted is fitted on counts by pattern: at most 2 ** labelers rows for each shape, whatever the corpus.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Workspace
from strandline.llm.spans import Finder, find, located, per_document

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "ssn", "iban", "local_phone", "account", "birth_date", "name"]

EMAIL_CHARS = "A-Za-z0-9._%+-"
#: Groups repeat possessively: Java matches other repeated groups by recursion, which long texts overflow.
#: An e-mail's name is a whole run of its characters, or what is left of the run after the match before.
EMAIL = rf"(?:\G|(?<![{EMAIL_CHARS}]))[{EMAIL_CHARS}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
FINDERS = [
    Finder("email", EMAIL, guard=r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]"),
    Finder("ip", r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", guard=r"[0-9]\.[0-9]"),
    Finder("card", r"[0-9](?:[\x20-]?[0-9])++", guard=r"(?:[0-9][\x20-]?){13}[0-9]"),
    Finder("phone", r"\+[0-9][\x20().0-9-]+[0-9]", guard=r"\+[0-9]"),
    Finder("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    Finder("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", guard=r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
    Finder("local_phone", r"(?<![0-9+().-])(?:\([0-9]{2,4}\)\x20?|[0-9]{3}[.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", guard=r"[0-9]{3}[\x20.-][0-9]{4}"),
    Finder("account", r"(?<![0-9A-Za-z-])[0-9]{8,17}(?![0-9A-Za-z-])", guard=r"[0-9]{8}"),
    Finder("birth_date", r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|[0-3]?[0-9][./][0-3]?[0-9][./](?:19|20)[0-9]{2})(?![0-9./-])", guard=r"(?:19|20)[0-9]{2}"),
]

#: Words that stand before data of a kind.
CUES = {
    "email": r"(?i)(e-?mail|contact|write to|reply)\W*(\w+\W+){0,2}$",
    "ip": r"(?i)\b(ip|address|host|server|from|login)\W*(\w+\W+){0,2}$",
    "card": r"(?i)\b(card|visa|credit|payment|paid)\W*(\w+\W+){0,3}$",
    "phone": r"(?i)\b(phone|tel|telephone|call|mobile|cell|fax|reach)\W*(\w+\W+){0,3}$",
    "ssn": r"(?i)\b(ssn|social security|tax id)\W*(\w+\W+){0,3}$",
    "iban": r"(?i)\b(iban|account|bank|transfer)\W*(\w+\W+){0,3}$",
    "local_phone": r"(?i)\b(phone|tel|telephone|call|mobile|cell|fax|reach)\W*(\w+\W+){0,3}$",
    "account": r"(?i)\b(account|acct|customer|passport|licen[cs]e|member|patient|policy)\W*(\w+\W+){0,3}$",
    "birth_date": r"(?i)\b(born|birth|dob|birthday)\W*(\w+\W+){0,3}$",
    "name": r"(?i)\b(name|regards|sincerely|signed|contact|dear|patient|customer)\W*(\w+\W+){0,2}$",
}
#: Given names of the default name gazetteer.
GIVEN = [
    "James", "Mary", "John", "Patricia", "Robert", "Jennifer", "Michael", "Linda", "David", "Elizabeth", "William", "Barbara", "Richard", "Susan", "Joseph", "Jessica", "Thomas", "Sarah",
    "Anna", "Maria", "Peter", "Hans", "Klaus", "Ursula", "Pierre", "Marie", "Jean", "Luis", "Carlos", "Carmen", "Ana", "Jose", "Juan", "Paul", "Laura", "Daniel", "Emma", "Julia", "Martin",
]
#: Top-level domains, calling codes, countries of bank accounts, and first digits of cards that the other gazetteers know.
GAZETTEER = {
    "email": r"(?i)\.(com|org|net|edu|gov|de|fr|es|uk|io|info|eu)$",
    "phone": r"^\+(1|7|20|27|3[0-4]|36|39|4[0134]|4[5-9]|5[1-8]|6[0-6]|8[1246]|86|9[0-58])",
    "iban": r"^(AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6)",
}


def alternatives(names: list[str]) -> str:
    return "|".join(re.escape(x) for x in sorted(set(names), key=lambda x: (-len(x), x)))


def name_finder(given: list[str]) -> Finder:
    """Names after a title or words that announce one, and given names of the gazetteer with a family name."""
    one, two = r"\p{Lu}\p{Ll}+", r"\p{Lu}\p{Ll}+(?:\x20\p{Lu}\p{Ll}+)?"
    forms = [rf"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame)\.?\x20{two}", rf"(?<=[Nn]ame\x20is\x20|[Nn]ame:\x20|Dear\x20|Regards,\x20|Sincerely,\x20|Signed\x20){two}"]
    guards = [r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señora?|Monsieur|Madame)\.?\x20\p{Lu}", r"(?:[Nn]ame(?:\x20is|:)|Dear|Regards,|Sincerely,|Signed)\x20\p{Lu}"]
    if given:
        forms.append(rf"(?<![\p{{L}}])(?:{alternatives(given)})\x20{one}")
        guards.append(rf"(?:{alternatives(given)})\x20\p{{Lu}}")
    return Finder("name", "|".join(forms), guard="|".join(guards))


LABELERS = ["form", "checked", "gazetteer", "cue", "company"]
SHAPES = {"digits": 10, "length": 15}
ROUNDS = 8


def by_kind(table: dict[str, Column], other: Column) -> Column:
    out = None
    for kind, value in table.items():
        out = F.when(F.col("kind") == kind, value) if out is None else out.when(F.col("kind") == kind, value)
    return out.otherwise(other)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a text of digits passes Luhn's check."""
    placed = F.transform(F.split(F.reverse(number), ""), lambda x, i: x.cast("int") * (1 + i % 2))
    return F.aggregate(placed, F.lit(0), lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def valid(value: Column) -> dict[str, Column]:
    """The base kinds' checks, and those of the kinds that have one."""
    n = F.length(digits(value))
    parts = F.transform(F.split(value, r"\."), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
    area = F.substring(value, 1, 3)
    return {
        "email": F.lit(True),
        "ip": F.forall(parts, lambda x: (F.length(x) <= 3) & (F.try_to_number(x, F.lit("999")) <= 255)),
        "card": n.between(14, 19) & luhn(digits(value)),
        "phone": n.between(10, 15),
        "ssn": ~area.isin("000", "666") & (area < "900") & (F.substring(value, 5, 2) != "00") & (F.substring(value, 8, 4) != "0000"),
        "birth_date": F.regexp_extract(value, "((?:19|20)[0-9]{2})", 1).between("1910", "2020"),
    }


def votes(rows: DataFrame, given: list[str]) -> DataFrame:
    """rows of located() with a 0/1 column for each labeler, shapes, and ``base``, whether the span is a base span."""
    loose = F.col("kind").isin("account", "birth_date", "name")
    known = {k: F.rlike("value", F.lit(p)) for k, p in GAZETTEER.items()} | ({"name": F.rlike("value", F.lit(rf"(?<![\p{{L}}])(?:{alternatives(given)})(?![\p{{L}}])"))} if given else {})
    found = rows.withColumns({
        "form": (~loose).cast("int"),
        "gazetteer": by_kind(known, F.lit(False)).cast("int"),
        "cue": by_kind({k: F.rlike("before", F.lit(p)) for k, p in CUES.items()}, F.lit(False)).cast("int"),
    })
    checks = valid(F.col("value"))
    checks |= {"account": F.col("cue") == 1, "birth_date": checks["birth_date"] & (F.col("cue") == 1), "name": F.col("gazetteer") == 1}
    passed = F.coalesce(by_kind(checks, F.lit(False)), F.lit(False))
    found = found.withColumns({"checked": passed.cast("int"), "base": F.col("kind").isin(*BASE) & passed})
    # Whether a base span of the same text stands by: kinds that come together support each other.
    texts = found.where("base").select("_rid").distinct().withColumnRenamed("_rid", "_near")
    found = found.join(texts, F.col("_rid") == F.col("_near"), "left").withColumn("company", (F.col("_near").isNotNull() & ~F.col("base")).cast("int"))
    n = F.length(digits(F.col("value")))
    return found.select("_rid", "kind", "start", "end", "base", *LABELERS, (n >= SHAPES["digits"]).cast("int").alias("digits"), (F.length("value") >= SHAPES["length"]).cast("int").alias("length"))


def clipped(p: float) -> float:
    return min(max(p, 1e-3), 1 - 1e-3)


def log_odds(prior: float, true: dict[str, float], false: dict[str, float]) -> Column:
    z = F.lit(math.log(prior / (1 - prior)))
    for k in LABELERS:
        z += F.col(k) * math.log(true[k] / false[k]) + (1 - F.col(k)) * math.log((1 - true[k]) / (1 - false[k]))
    return z


def reliabilities(patterns: DataFrame) -> tuple[float, dict[str, float], dict[str, float]]:
    """Expectation-maximisation over (labelers, n): the share of true spans, and how often each labeler votes on true and false ones."""
    prior, true, false = 0.5, dict.fromkeys(LABELERS, 0.7), dict.fromkeys(LABELERS, 0.3)
    for _ in range(ROUNDS):
        p = 1 / (1 + F.exp(-log_odds(prior, true, false)))
        weighted = patterns.select("n", (F.col("n") * p).alias("t"), *LABELERS)
        sums = [F.sum(F.col("t") * F.col(k)).alias(f"t_{k}") for k in LABELERS] + [F.sum((F.col("n") - F.col("t")) * F.col(k)).alias(f"f_{k}") for k in LABELERS]
        r = weighted.agg(F.sum("n").alias("n"), F.sum("t").alias("t"), *sums).first()
        if not r["n"]:
            break
        prior = clipped(r["t"] / r["n"])
        true = {k: clipped((r[f"t_{k}"] + 1) / (r["t"] + 2)) for k in LABELERS}
        false = {k: clipped((r[f"f_{k}"] + 1) / (r["n"] - r["t"] + 2)) for k in LABELERS}
    return prior, true, false


def classifier(patterns: DataFrame, prior: float, true: dict[str, float], false: dict[str, float]) -> list[float]:
    """Weights of (1, labelers, shapes): logistic regression on the posteriors by Newton's method, each step one aggregation."""
    inputs = [F.lit(1.0), *map(F.col, [*LABELERS, *SHAPES])]
    names = range(len(inputs))
    soft = patterns.withColumn("y", 1 / (1 + F.exp(-log_odds(prior, true, false))))
    w = np.zeros(len(inputs))
    for _ in range(5):
        z = sum((x * float(c) for x, c in zip(inputs, w)), F.lit(0.0))
        step = soft.withColumn("p", 1 / (1 + F.exp(-z)))
        grad = [F.sum(F.col("n") * (F.col("p") - F.col("y")) * inputs[i]).alias(f"g{i}") for i in names]
        hess = [F.sum(F.col("n") * F.col("p") * (1 - F.col("p")) * inputs[i] * inputs[j]).alias(f"h{i}_{j}") for i in names for j in names if i <= j]
        r = step.agg(*grad, *hess).first()
        if r["g0"] is None:
            break
        g = np.array([r[f"g{i}"] for i in names]) + w
        h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in names] for i in names]) + np.eye(len(inputs))
        w = w - np.linalg.solve(h, g)
    return w.tolist()


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, given: list[str] | None = None) -> DataFrame:
    """A row per row of docs: its id, n_email, n_ip, n_card, n_phone, base_sha256 and spans (kind:start:end, comma-joined).

    given: the given names of the name gazetteer, GIVEN by default. Null and empty texts have no span; rows that repeat are labelled
    apart with equal results; other columns are not read. Without any span nothing is fitted. A candidate that overlaps a base span is not added.
    """
    work = Workspace(docs.sparkSession, "pii")
    given = GIVEN if given is None else given
    found = work.stage(find(docs, [*FINDERS, name_finder(given)], id_col, text_col), "found")
    rows = work.stage(votes(located(found), given), "votes")
    patterns = work.stage(rows.groupBy(*LABELERS, *SHAPES).agg(F.count("*").cast("double").alias("n")).coalesce(1), "patterns")
    w = classifier(patterns, *reliabilities(patterns))
    z = sum((F.col(k) * c for k, c in zip([*LABELERS, *SHAPES], w[1:])), F.lit(w[0]))
    more = rows.where(~F.col("kind").isin(*BASE) & (1 / (1 + F.exp(-z)) >= threshold))
    base = rows.where("base").select("_rid", "kind", "start", "end")
    b = base.select(F.col("_rid").alias("_b"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    more = more.join(b, (F.col("_rid") == F.col("_b")) & (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end")), "left_anti")
    return per_document(found, base.unionByName(more.select("_rid", "kind", "start", "end")), KINDS, BASE, id_col)
