"""Secret scanning by linking the parts of credentials, with DataFrame functions alone.

Strong findings (assignments, access-key ids, long hex strings) stand for themselves. Weak candidates, which alone are as
often harmless, are parts of a credential: identifiers, secrets and endpoints. A weak candidate is reported only if a
complementary part, strong or weak, lies in its scope: in the same text with at most ``reach`` code points between the two. Scopes are
joined as intervals through bins of that width: a part's scope takes the bins that it touches, and meets the parts that start or end there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Workspace
from strandline.llm.spans import Finder, find, located, per_document

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "user", "keyid", "secret", "endpoint"]
REACH = 300

#: Strong kinds, of fixed form.
STRONG = [
    Finder("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=1),
    Finder("access", r"AKIA[A-Z0-9]+"),
    Finder("hex", r"[0-9a-f]{24,}"),
]
#: Weak kinds.
WEAK = [
    Finder("user", r"""(?<![A-Za-z0-9_])(?:[uU]ser(?:_?name)?|USER(?:_?NAME)?|[lL]ogin|LOGIN|[cC]lient_?[iI]d|CLIENT_?ID)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,}+)""", group=1),
    Finder("keyid", r"(?<![A-Za-z0-9])(?=[A-Z0-9]*[0-9])(?=[A-Z0-9]*[A-Z])[A-Z0-9]{16,}+(?![A-Za-z0-9])", guard=r"[A-Z0-9]{16}"),
    Finder("secret", r"(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{32,}+={0,2}+(?![A-Za-z0-9+/=])", guard=r"[A-Za-z0-9+/]{32}"),
    Finder("endpoint", r"""(?:https?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[A-Za-z0-9._~:@%/?&=+-]{4,}""", guard="://"),
]
ROLE = {"assign": "secret", "hex": "secret", "secret": "secret", "access": "id", "keyid": "id", "user": "id", "endpoint": "endpoint"}
#: What a weak part of a role needs in its scope.
NEEDS = [("id", "secret"), ("secret", "id"), ("secret", "endpoint"), ("endpoint", "secret")]


def strong_only(spans: DataFrame) -> DataFrame:
    """Base findings that pass: an assigned value of 6, an access id of 20, a hex string of 24 characters or more."""
    k, n = F.col("kind"), F.length("value")
    return spans.where(((k == "assign") & (F.length("part") >= 6)) | ((k == "access") & (n >= 20)) | ((k == "hex") & (n >= 24)))


def links(spans: DataFrame, reach: int = REACH) -> DataFrame:
    """Pairs of complementary parts of one text within reach: _rid, kind, start, end and other_kind, other_start, other_end."""
    role = F.element_at(F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv]), F.col("kind"))
    place = lambda c: F.floor(F.col(c) / reach)
    parts = spans.select("_rid", "kind", "start", "end", role.alias("role"))
    near = parts.withColumn("bin", F.explode(F.sequence(place("start") - 1, place("end") + 1)))
    other = parts.withColumn("bin", F.explode(F.array_distinct(F.array(place("start"), place("end")))))
    other = other.select("_rid", "bin", *(F.col(c).alias(f"other_{c}") for c in ("kind", "start", "end", "role")))
    gap = F.greatest(F.col("other_start") - F.col("end"), F.col("start") - F.col("other_end"))  # below 0: one string isn't two parts
    fits = F.concat_ws("+", "role", "other_role").isin(*("+".join(x) for x in NEEDS)) & gap.between(0, reach)
    return near.join(other, ["_rid", "bin"]).where(fits).drop("bin", "role", "other_role").distinct()


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """A row per row of docs: its id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end, comma-joined).

    Null and empty texts have no span; rows that repeat are scanned apart with equal results; other columns are not read.
    """
    work = Workspace(docs.sparkSession, "secrets")
    found = work.stage(find(docs, [*STRONG, *WEAK], id_col, text_col), "found")
    rows = located(found)
    strong = strong_only(rows.where(F.col("kind").isin(*BASE)))
    parts = work.stage(strong.unionByName(rows.where(~F.col("kind").isin(*BASE))).select("_rid", "kind", "start", "end"), "parts")
    linked = links(parts, reach).where(~F.col("kind").isin(*BASE)).select("_rid", "kind", "start", "end").distinct()
    return per_document(found, parts.where(F.col("kind").isin(*BASE)).unionByName(linked), KINDS, BASE, id_col)
