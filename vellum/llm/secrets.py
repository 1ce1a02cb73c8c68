"""Secret scans: fixed patterns, and tokens that character Markov models hold for random."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import scanned
from ..functions.text import bound
from .common import table

# The base patterns.
_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = r"AKIA[A-Z0-9]+"
# Of the runs of hex digits, those with 24 or more: the longest match at the first place is the whole run.
_HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

#: What the models know; any other character ends a token.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
_WIDTH = len(ALPHABET) + 1
#: Labelled rows whose text gives ordinary identifiers, and random strings, at most.
SAMPLE_DOCS = 500
SAMPLE_RANDOM = 4000
#: The log-likelihood ratio above which a token counts as random.
MARGIN = 12.0


def _pairs(strings: DataFrame) -> dict[str, int]:
    """How often each pair of characters occurs in strings(token), ^ standing for the start. At most _WIDTH ** 2 pairs."""
    chars = F.filter(F.split("token", ""), lambda c: c != "")
    pairs = strings.select(chars.alias("c")).select(F.explode(F.transform("c", lambda c, i: F.concat(F.when(i == 0, "^").otherwise(F.get("c", i - 1)), c))).alias("pair"))
    return {r["pair"]: r["count"] for r in pairs.groupBy("pair").count().collect() if all(x in ALPHABET + "^" for x in r["pair"])}


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios of random against ordinary, for each character after each other."""

    weights: tuple[float, ...]

    def score(self, token: Column) -> Column:
        """The token's log-likelihood ratio, in one pass over its characters."""
        weights = F.split(F.lit(",".join(f"{w:.6f}" for w in self.weights)), ",").cast("array<double>")

        def step(acc, c):
            at = F.instr(F.lit(ALPHABET), c)
            return F.struct((acc["s"] + F.coalesce(F.get(weights, acc["p"] * _WIDTH + at), F.lit(0.0))).alias("s"), at.alias("p"))

        chars = F.filter(F.split(token, ""), lambda c: c != "")
        return F.aggregate(chars, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("p")), step)["s"]


def fit(random: DataFrame, ordinary: DataFrame) -> Model | None:
    """Two first-order Markov models, add-one smoothed, from labelled strings (column token). None without samples of either label."""
    counts = [_pairs(random), _pairs(ordinary)]
    if not all(counts):
        return None
    states = ["^", *ALPHABET]
    weights = []
    for a in states:
        totals = [sum(c.get(a + b, 0) for b in ALPHABET) + len(ALPHABET) for c in counts]
        weights.append(0.0)
        weights += [math.log((counts[0].get(a + b, 0) + 1) / totals[0]) - math.log((counts[1].get(a + b, 0) + 1) / totals[1]) for b in ALPHABET]
    return Model(tuple(weights))


def random_strings(spark: SparkSession, n: int = SAMPLE_RANDOM) -> DataFrame:
    """n strings made from hashes: base64, letters and digits, upper case and digits, and hex."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    b64 = F.base64(F.unhex(digest))
    bare = F.regexp_replace(b64, "[+/=]", "")
    return spark.range(n).select(F.when(F.col("id") % 4 == 0, b64).when(F.col("id") % 4 == 1, bare).when(F.col("id") % 4 == 2, F.upper(bare)).otherwise(digest).alias("token"))


def ordinary_identifiers(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_DOCS) -> DataFrame:
    """Words and names made of words, from the `bound` documents of good quality with the lowest ids."""
    chosen = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("good_id")).distinct().orderBy("good_id").limit(bound)
    # At most `bound` ids are broadcast.
    words = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("good_id")).select(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0)).alias("w"))
    low = lambda w: F.lower(w)

    def name(w, i):
        after = F.coalesce(F.get("w", i + 1), F.lit("x"))
        kinds = (
            w,
            low(w),
            F.concat(low(w), F.lit("_"), low(after)),
            F.concat(low(w), F.initcap(after)),
            F.concat(F.initcap(w), F.initcap(after)),
            F.concat(F.upper(w), F.lit("_"), F.upper(after)),
            F.concat(low(w), F.lit("-"), low(after), F.lit("/"), low(w)),
            F.concat(low(w), F.lit("_"), (i % 100).cast("string")),
            F.upper(w),
        )
        out = kinds[0]
        for k, x in enumerate(kinds[1:], 1):
            out = F.when(i % len(kinds) == k, x).otherwise(out)
        return out

    return words.select(F.explode(F.transform("w", name)).alias("token"))


def trained(docs: DataFrame, sf_dir: str) -> Model | None:
    """The model for a corpus whose labels lie beside it."""
    spark = docs.sparkSession
    return fit(random_strings(spark), ordinary_identifiers(docs, table(spark, sf_dir, "labels")))


_SPAN = "struct<start:int,rank:int,end:int,kind:string,match:string>"
#: Code points of the pieces in which a text with spans is redacted.
CHUNK = 4096


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """array<struct(start, rank, end, kind, match)> of the pattern's matches, leftmost and not overlapping."""
    rank = KINDS.index(kind)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # Between two matches stands what split() returns, so lengths add up to places.
    around = F.arrays_zip(F.split(text, pattern, -1).alias("before"), matches.alias("match"))
    begin = lambda at, z: at + F.length(z["before"])
    end = lambda at, z: begin(at, z) + F.coalesce(F.length(z["match"]), F.lit(0))
    span = lambda at, z: F.when(z["match"].isNotNull(), F.struct(begin(at, z).alias("start"), F.lit(rank).alias("rank"), end(at, z).alias("end"), F.lit(kind).alias("kind"), z["match"].alias("match")))
    return F.when(text.rlike(pattern), F.array_compact(scanned(around, F.lit(0), end, span, _SPAN))).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _apart(tokens: Column, base: Column) -> Column:
    """For each token whether no base span overlaps it: whether, of the spans that begin before its end, none ends after its start."""
    event = lambda at, which, other: F.struct(at.alias("at"), F.lit(which).alias("which"), other.alias("other"))
    events = F.array_sort(F.concat(F.transform(tokens, lambda t: event(t["end"], 0, t["start"])), F.transform(base, lambda b: event(b["start"], 1, b["end"]))))
    furthest = lambda reached, e: F.when(e["which"] == 1, F.greatest(reached, e["other"])).otherwise(reached)
    return F.array_compact(scanned(events, F.lit(0), furthest, lambda reached, e: F.when(e["which"] == 0, reached <= e["other"]), "boolean"))


def scan(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with `base` and `spans`: arrays of struct(start, rank, end, kind, match), by start, then kind.

    Base spans are the fixed patterns' matches; a value of an assignment has 6 characters or more,
    an access key 20, hex 24. The model adds tokens of 20 characters or more with a letter,
    outside all base spans, whose log-likelihood ratio is above MARGIN. A null text is empty
    and has no spans; repeated rows are scanned each; an empty table gives no rows; all columns
    of docs stay. One pass without a shuffle. Without a model only base spans are found.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = F.filter(_spans(text, _ASSIGN, "assign"), lambda s: F.length(F.regexp_extract(s["match"], _ASSIGN, 2)) >= 6)
    access = F.filter(_spans(text, _ACCESS, "access"), lambda s: F.length(s["match"]) >= 20)
    out = docs.withColumn("base", F.array_sort(F.concat(assign, access, _spans(text, _HEX, "hex"))))
    if model is None:
        return out.withColumn("spans", F.col("base"))
    def odd(tokens: Column) -> Column:
        fine = F.when((F.size(tokens) > 0) & (F.size("base") > 0), _apart(tokens, F.col("base")))
        return bound(fine, lambda fine: F.filter(tokens, lambda s, i: F.coalesce(F.get(fine, i), F.lit(True)) & (model.score(s["match"]) > MARGIN)))

    tokens = F.filter(_spans(text, _TOKEN, "random"), lambda s: s["match"].rlike("[A-Za-z]"))
    return out.withColumn("spans", F.array_sort(F.concat(F.col("base"), bound(tokens, odd))))


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) for every row of docs."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs.select("doc_id", "text"), model).select(
        "doc_id",
        *map(count, KINDS[:3]),
        F.sha2(_listed("base"), 256).alias("base_sha256"),
        _listed("spans").alias("spans"),
        count("random"),
    )


def _cut(text: Column, spans: Column, mark: str) -> Column:
    """The text with each run of overlapping or touching spans replaced by the mark.

    The text is worked on in pieces of CHUNK code points, each with the parts of spans that lie in it, so that no cut is
    counted from the beginning of a long text.
    """
    part = lambda reached, s: F.struct(F.greatest(reached, s["start"]).alias("a"), s["end"].alias("b"), (s["start"] > reached).alias("new"))
    parts = F.filter(scanned(spans, F.lit(-1), lambda reached, s: F.greatest(reached, s["end"]), part, "struct<a:int,b:int,new:boolean>"), lambda p: p["b"] > p["a"])

    def dealt(p: Column) -> Column:
        first = F.floor(p["a"] / CHUNK).cast("int")
        within = lambda c: F.struct(c.alias("c"), (F.greatest(p["a"], c * CHUNK) - c * CHUNK).alias("a"), (F.least(p["b"], (c + 1) * CHUNK) - c * CHUNK).alias("b"), (p["new"] & (c == first)).alias("new"))
        return F.transform(F.sequence(first, F.floor((p["b"] - 1) / CHUNK).cast("int")), within)

    def joined(chunk: Column, own: Column) -> Column:
        kept = lambda p, j: F.concat(F.substring(chunk, F.coalesce(F.get(own, j - 1)["b"], F.lit(0)) + 1, p["a"] - F.coalesce(F.get(own, j - 1)["b"], F.lit(0))), F.when(p["new"], mark).otherwise(""))
        rest = F.substring(chunk, F.coalesce(F.get(own, F.size(own) - 1)["b"], F.lit(0)) + 1, F.lit(CHUNK))
        return F.array_join(F.concat(F.transform(own, kept), F.array(rest)), "")

    def of_chunks(chunks: Column, parts: Column) -> Column:
        # How many parts lie before each chunk, from both in one order.
        chunk_at = F.transform(chunks, lambda c, i: F.struct(i.cast("int").alias("at"), F.lit(0).alias("which")))
        events = F.array_sort(F.concat(chunk_at, F.transform(parts, lambda p: F.struct(p["c"].alias("at"), F.lit(1).alias("which")))))
        before = F.array_compact(scanned(events, F.lit(0), lambda n, e: n + e["which"], lambda n, e: F.when(e["which"] == 0, n), "int"))
        own = lambda first, i: F.slice(parts, F.get(first, i) + 1, F.coalesce(F.get(first, i + 1), F.size(parts)) - F.get(first, i))
        return bound(before, lambda first: F.transform(chunks, lambda c, i: bound(own(first, i), lambda p: joined(c, p))))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return F.array_join(bound(F.flatten(F.transform(parts, dealt)), lambda p: bound(chunks, lambda c: of_chunks(c, p))), "")


def redacted(docs: DataFrame, model: Model | None, mark: str = "[secret]") -> DataFrame:
    """docs with every span, or run of overlapping spans, replaced by `mark`; texts without spans stay as they are."""
    # The row travels in a struct, so that its columns may have any names.
    found = scan(docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), "text"), model)
    text = F.when(F.size("spans") > 0, _cut(F.col("text"), F.col("spans"), mark)).otherwise(F.col("text"))
    # In a step of its own: a lambda would take an output column named text for the input's.
    done = found.select("row", text.alias("redacted"))
    changed = {"text": F.col("redacted").alias("text"), "n_chars": F.length("redacted").cast("long").alias("n_chars")}
    return done.select(*(changed.get(c, F.col(f"row.`{c}`").alias(c)) for c in docs.columns))
