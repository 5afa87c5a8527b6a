"""Secret scans in DataFrame operations only, weighed by who owns a value across the corpus.

Patterns propose candidates; each candidate's hash is counted by distinct repositories and
owners over all rows.  A value that a share of the corpus's owners hold, or that stands in many
repositories of its owners, is a widely copied example; another one that looks random is taken for
a live credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialise

#: In the order in which kinds of equal start are listed; ``known`` is added to the three base kinds.
KINDS = ("assign", "access", "hex", "known")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: To its END line, or where that is missing over the lines of its body; no dash run is read twice.
KEY_BLOCK = r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*+(?:-[^-]++)*+-----END [A-Z ]*PRIVATE KEY-----|(?:\s*+[A-Za-z0-9+/=]{40,}+)*+)"
PATTERNS = {
    "assign": ASSIGN,
    # A maximal run decides for these two, so the least length can stand in the pattern.
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"[0-9a-f]{24,}+",
    # Public prefixes of issued credentials, web tokens of any length (from where a run begins, so that none is read twice), and private key blocks.
    "known": r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk_live_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35})|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+|" + KEY_BLOCK,
}
#: No pattern names these characters, and none matches U+0001, so matches can be marked with it.
MARK, OTHER = "\x01", "\x02"
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx|1234567|test[_-]?(key|token)"


#: start, number (of the kind), end, value hash and looks of a candidate.
SPANS = "array<struct<start:int,number:int,end:int,value:bigint,looks:boolean>>"


def _pieces(text: Column, kind: str) -> Column:
    """The text cut at the kind's matches: what stands before the first, the first, what stands between, and so on."""
    return F.split(F.regexp_replace(F.translate(text, MARK, OTHER), PATTERNS[kind], f"{MARK}$0{MARK}"), MARK, -1)


def _with_starts(df: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Adds _<kind>_at, where each piece of _<kind> begins, for texts with a match.

    Lengths are summed up in blocks of some square root of their number, step by step in columns of their own, as what a
    lambda refers to is worked out anew for each element: so very many matches in a text stay cheap.
    """
    add = lambda a, x: a + x
    upto = lambda values, n: F.aggregate(F.slice(values, F.lit(1), n), F.lit(0), add)

    def each(out: str, made) -> dict[str, Column]:
        return {f"_{k}_{out}": F.when(F.size(f"_{k}") > 1, made(f"_{k}")) for k in kinds}

    df = df.withColumns(each("len", lambda k: F.transform(k, F.length)))
    df = df.withColumns(each("side", lambda k: F.ceil(F.sqrt(F.size(k))).cast("int")))
    df = df.withColumns(each("block", lambda k: F.transform(F.sequence(F.lit(0), F.ceil(F.size(k) / F.col(f"{k}_side")).cast("int") - 1), lambda b: F.slice(f"{k}_len", b * F.col(f"{k}_side") + 1, F.col(f"{k}_side")))))
    df = df.withColumns(each("sum", lambda k: F.transform(f"{k}_block", lambda x: F.aggregate(x, F.lit(0), add))))
    df = df.withColumns(each("before", lambda k: F.transform(F.sequence(F.lit(0), F.size(f"{k}_sum") - 1), lambda b: upto(F.col(f"{k}_sum"), b))))
    df = df.withColumns(each("at", lambda k: F.flatten(F.zip_with(f"{k}_block", f"{k}_before", lambda x, o: F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda j: o + upto(x, j))))))
    return df.drop(*[f"_{k}_{x}" for k in kinds for x in ("len", "side", "block", "sum", "before")])


def _spans(pieces: Column, starts: Column, kind: str) -> Column:
    """``SPANS`` of one kind: every second piece is a match."""

    def span(i: Column) -> Column:
        found, start = F.get(pieces, i), F.get(starts, i)
        v = F.regexp_extract(found, ASSIGN, 2) if kind == "assign" else found
        # Of mixed characters and enough different ones; a rough sign of randomness.
        looks = (F.length(v) >= 16) & v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(v, ""))) >= 8) & ~v.rlike(PLACEHOLDER) | v.rlike(r"^-----BEGIN[^-]*-----\s*[^\s-]")
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("number"), (start + F.length(found)).alias("end"), F.xxhash64(v).alias("value"), looks.alias("looks"))

    places = F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2))
    if kind == "assign":
        # A span is the whole match; what its value is too short for is dropped without another try.
        places = F.filter(places, lambda i: F.length(F.regexp_extract(F.get(pieces, i), ASSIGN, 2)) >= 6)
    return F.when(F.size(pieces) > 1, F.transform(places, span)).otherwise(F.array().cast(SPANS))


def find_secrets(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None, owner: Column | None = None, keep: str | None = None) -> DataFrame:
    """The id column, repository, owner and candidates (by start, then kind) of each row, and ``keep``, if named: a struct of all its columns.

    A null text is empty; a null id is a repository of its own kind, a null owner the empty one.
    """
    kept = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(keep)] if keep else []
    rows = df.select(F.col(id_col), F.coalesce((F.col(id_col) if repository is None else repository).cast("string"), F.lit("null")).alias("repository"), F.coalesce((F.lit("") if owner is None else owner).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *kept)
    rows = rows.withColumns({f"_{k}": _pieces(F.col("_text"), k) for k in KINDS}).drop("_text")
    rows = _with_starts(rows)
    found = F.array_sort(F.concat(*[_spans(F.col(f"_{k}"), F.col(f"_{k}_at"), k) for k in KINDS]))
    return rows.select(id_col, "repository", "owner", found.alias("candidates"), *([keep] if keep else []))


def ownership(found: DataFrame) -> DataFrame:
    """value, repositories, owners: over the whole corpus, how many distinct ones hold each candidate value."""
    seen = found.select("repository", "owner", F.explode(F.array_distinct(F.transform("candidates", lambda c: c["value"]))).alias("value"))
    # Pre-aggregated by (value, owner, repository), then by (value, owner), so a value that is everywhere is counted by many tasks.
    pairs = seen.distinct().groupBy("value", "owner").agg(F.count("*").alias("n"))
    return pairs.groupBy("value").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"))


def scan_secrets(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None, owner: Column | None = None, keep: str | None = None, most_owners: int = 1, owner_share: float = 0.05, most_repositories: int = 20, repository_share: float = 1e-4) -> DataFrame:
    """Each row's candidates with what the corpus says of their values.

    Returns the id column, candidates (array of start, number, end, value hash, looks; start and end are
    code points, ``number`` indexes ``KINDS``), live (those that look random and are not shared), n_live and
    n_shared, and ``keep``, if named: a struct of all the row's columns.  Shared are values of more owners than ``most_owners`` and ``owner_share`` of the corpus's owners,
    or of more repositories an owner than ``most_repositories`` and ``repository_share`` of the corpus's
    repositories.  Every input row gives one row, whatever its id: null ids and repeated ones stay apart, and equal
    rows have equal results; as repositories rows of one id count once, null ids together once.  An empty table gives no rows.
    """
    # Numbered before they are written, so that a number stays what it is when a task is run again.
    found = materialise(find_secrets(df, id_col=id_col, text_col=text_col, repository=repository, owner=owner, keep=keep).withColumn("uid", F.monotonically_increasing_id()))
    owner_limit = max(most_owners, owner_share * found.select("owner").distinct().count())
    repository_limit = max(most_repositories, repository_share * found.select("repository").distinct().count())
    shared = (F.col("owners") > owner_limit) | (F.col("repositories") > repository_limit * F.col("owners"))
    # Written, so that both sides of the join below are plain shuffles: Spark then splits a value that many rows hold.
    judged = materialise(ownership(found).select("value", shared.alias("shared")))
    each = found.filter("size(candidates) > 0").select("uid", F.explode("candidates").alias("c")).withColumn("value", F.col("c.value"))
    told = each.join(judged, "value").groupBy("uid").agg(
        F.array_sort(F.collect_list(F.when(F.col("c.looks") & ~F.col("shared"), F.col("c")))).alias("live"),
        F.count_if("shared").alias("n_shared"),
    )
    kept = [keep] if keep else []
    # Most rows hold nothing and need no join.
    rest = found.filter("size(candidates) = 0").select(id_col, "candidates", F.array().cast(SPANS).alias("live"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_shared"), *kept)
    full = found.filter("size(candidates) > 0").join(told, "uid").select(id_col, "candidates", "live", F.size("live").cast("long").alias("n_live"), "n_shared", *kept)
    return full.unionByName(rest)


def span_list(candidates: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the candidates of these kinds, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    own = F.filter(candidates, lambda c: c["number"].isin([KINDS.index(k) for k in kinds]))
    return F.array_join(F.transform(own, lambda c: F.concat_ws(":", F.get(names, c["number"]), c["start"].cast("string"), c["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span's characters replaced by ``mark``; overlapping spans are joined."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
