"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Base spans are the matches of three fixed patterns. Further candidates (vendor-shaped tokens and long mixed
strings) are added only where the corpus says they look live: the hash of every candidate value is aggregated
by distinct repositories and owners. A value is specific to its owners while few owners hold it, each in few
repositories; one that many owners hold, or one owner in many repositories, is a copied example. A document
stands for a repository, its source for the owner.

Positions come from the text between matches: split and regexp_extract_all run over the same engine, so
the lengths of their pieces alternate. Counting is by (value, owner, repository), then by (value, owner), then
by value, each combined before the shuffle, so a value in a third of all documents gathers in no task.

Defined cases: null text counts as empty; a document without spans has zero counts, the hash of the empty
string and empty spans; a null source is one owner, a null id one repository; repeated rows are each scanned, and
count as one repository; extra columns are ignored; long texts are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import written

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Runs are maximal, so a shorter run can be left to the pattern: no match may start inside one that fails.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
VENDOR = r"gh[opsru]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
MIXED = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[A-Z0-9+/_-]*+[a-z])(?=[a-z0-9+/_-]*+[A-Z])[A-Za-z0-9+/_-]{32,}"

#: Kinds in the order in which spans that start together are listed; (name, pattern, group of the value, least value characters).
BASE = (("assign", ASSIGN, 1, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
ADDED = (("vendor", VENDOR, 0, 1), ("mixed", MIXED, 0, 32))
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


#: Matches whose positions are added up together; sums over these chunks keep the work of a text with n spans near n * CHUNK.
CHUNK = 64


def pieces(text: Column, pattern: str, group: int) -> Column:
    """The text before each match, the match and its value, in order; null where nothing matches, so such texts skip all but one scan."""
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.filter(F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value")), lambda x: x["whole"].isNotNull())
    parts = F.sequence(F.lit(0), F.floor((F.size(zipped) - 1) / CHUNK).cast("int"))
    return F.when(F.rlike(text, F.lit(pattern)), F.transform(parts, lambda k: F.slice(zipped, k * CHUNK + 1, F.lit(CHUNK))))


def spans(chunks: Column, kind: str, least: int, rank: int) -> Column:
    """Spans of one kind from its pieces, ordered by start; code points, end exclusive."""

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["whole"])
        found = F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), end.cast("int").alias("end"), F.lit(kind).alias("kind"), F.md5(x["value"].cast("binary")).alias("value"))
        kept = F.length(x["value"]) >= least
        return F.struct(end.cast("int").alias("at"), F.when(kept, F.concat(state["spans"], F.array(found))).otherwise(state["spans"]).alias("spans"))

    def walked(chunk: Column, at: Column) -> Column:
        return F.aggregate(chunk, F.struct(at.cast("int").alias("at"), F.array().cast(SPAN).alias("spans")), step, lambda s: s["spans"])

    lengths = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["whole"])))
    offsets = F.aggregate(lengths, F.array(F.lit(0)), lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n)))
    found = F.flatten(F.zip_with(chunks, F.slice(offsets, F.lit(1), F.size(chunks)), walked))
    return F.when(chunks.isNotNull(), found).otherwise(F.array().cast(SPAN))


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source", wide_owners: int = 3, wide_repositories: int = 20) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owner_specific (spans whose value fewer than wide_owners owners hold, each in fewer than wide_repositories)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = (*BASE, *ADDED)
    found = [spans(F.col(kind), kind, least, rank) for rank, (kind, _, _, least) in enumerate(kinds)]
    base, more = F.array_sort(F.concat(*found[: len(BASE)])), F.concat(*found[len(BASE) :])
    whose = [F.col(repository).cast("string").alias("repository"), F.coalesce(F.concat(F.lit("o"), F.col(owner).cast("string")), F.lit("")).alias("owner")]
    cut = docs.select("doc_id", *whose, *[pieces(text, pattern, group).alias(kind) for kind, pattern, group, _ in kinds])
    rows = cut.select("doc_id", "repository", "owner", base.alias("base"), more.alias("more"))
    free = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    rows = rows.withColumn("more", free).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "secret-spans")

    plain = (F.size("base") + F.size("more")) == 0
    values = F.array_distinct(F.transform(F.concat("base", "more"), lambda s: s["value"]))
    held = rows.where(~plain).select("row", "repository", "owner", F.explode(values).alias("value"))
    by_owner = held.select("value", "owner", "repository").distinct().groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    owned = written(by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.max("repositories").alias("repositories")), "secret-owners")
    few = owned.where((F.col("owners") < wide_owners) & (F.col("repositories") < wide_repositories))
    specific = held.select("row", "value").join(few.select("value"), "value")
    live = written(specific.groupBy("row").agg(F.collect_set("value").alias("live")), "secret-live")

    with_spans = rows.where(~plain).join(live, "row", "left").withColumn("live", F.coalesce("live", F.array().cast("array<string>")))
    kept = F.filter("more", lambda s: F.array_contains("live", s["value"]))
    both = F.array_sort(F.concat("base", kept))
    count = lambda name: F.size(F.filter("base", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    scanned = with_spans.select(
        "doc_id",
        *[count(name) for name, *_ in BASE],
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(both).alias("spans"),
        F.size(F.filter(both, lambda s: F.array_contains("live", s["value"]))).cast("long").alias("n_owner_specific"),
    )
    zero = F.lit(0).cast("long")
    none = rows.where(plain).select("doc_id", *[zero.alias(f"n_{name}") for name, *_ in BASE], F.sha2(F.lit("").cast("binary"), 256).alias("base_sha256"), F.lit("").alias("spans"), zero.alias("n_owner_specific"))
    return scanned.unionByName(none)
