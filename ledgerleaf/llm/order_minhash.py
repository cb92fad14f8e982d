"""Order MinHash fingerprints (DataFrame functions only).

A text is cut into tokens (words; runs beyond MOST characters are cut), its k-mers are runs of K tokens, numbered by occurrence.
Each numbered k-mer is hashed once; the top bits of the hash name one of BINS bins, and the ELL smallest of a bin are put back
in text order and hashed as a tuple. Two texts agree in a bin only if they share its minimal k-mers in the same order, so the
share of agreeing bins falls with edits that move text, not only with those that change the set of k-mers.

All steps are higher-order functions over one row's arrays: sorts and linear passes, with no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, ELL, BINS, MOST = 3, 2, 32, 16
#: Low bits of a packed value hold the position, the others the hash. No text of less than 2 GB has as many tokens.
POSITION = 30
LOW = (1 << POSITION) - 1
#: Rows of a run of neighbouring ids; most runs (longer ones then); values that a lookup compares at once; up to so many firsts of runs are broadcast.
RUN, RUNS, STEP, BROADCAST_ROWS = 512, 1 << 18, 64, 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pack(hashed: Column, position: Column) -> Column:
    return hashed.bitwiseAND(F.lit(~LOW)).bitwiseOR(position)


def _head(x: Column) -> Column:
    return x.bitwiseAND(F.lit(~LOW))


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(LOW))


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - (BINS - 1).bit_length())


def _upto(n: Column) -> Column:
    """0, 1, ..., n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _kmers(words: Column) -> Column:
    n = F.size(words)
    count = F.greatest(n - (K - 1), F.least(n, F.lit(1)))
    gram = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(K)])
    return F.sort_array(F.transform(_upto(count), lambda i: _pack(gram(i), F.least(i, F.lit(LOW)).cast("long"))))


def _numbered(kmers: Column) -> Column:
    """Hashes of k-mer and occurrence number, packed with the position; equal k-mers stand together in ``kmers``, in text order."""
    n = F.size(kmers)
    firsts = F.filter(_upto(n), lambda i: (i == 0) | (_head(F.get(kmers, i)) != _head(F.get(kmers, i - 1))))
    plain = F.transform(kmers, lambda x: _pack(F.xxhash64(_head(x), F.lit(0)), _low(x)))

    def run(starts: Column) -> Column:
        each = lambda at, j: F.transform(
            F.sequence(F.lit(0), F.coalesce(F.get(starts, j + 1), n) - at - 1), lambda o: _pack(F.xxhash64(_head(F.get(kmers, at)), o), _low(F.get(kmers, at + o)))
        )
        return F.when(F.size(starts) == n, plain).otherwise(F.flatten(F.transform(starts, each)))

    return let(firsts, run)


def _tuples(items: Column) -> Column:
    """One entry for each bin that holds anything: the bin in the upper half, the hash of its tuple in the lower half."""
    kept = F.filter(items, lambda x, i: (i < ELL) | (_bin(x) != _bin(F.get(items, i - ELL))))

    def entries(k: Column) -> Column:
        heads = F.filter(_upto(F.size(k)), lambda i: (i == 0) | (_bin(F.get(k, i)) != _bin(F.get(k, i - 1))))
        own = lambda i: F.filter(F.slice(k, i + 1, ELL), lambda x: _bin(x) == _bin(F.get(k, i)))
        ordered = lambda i: F.sort_array(F.transform(own(i), lambda x: F.shiftleft(_low(x), 63 - POSITION).bitwiseOR(F.shiftrightunsigned(x, POSITION + 1))))
        values = lambda i: F.transform(ordered(i), lambda x: x.bitwiseAND(F.lit((1 << (63 - POSITION)) - 1)))
        return F.transform(heads, lambda i: F.shiftleft(_bin(F.get(k, i)), 32).bitwiseOR(F.xxhash64(values(i)).bitwiseAND(F.lit(0xFFFFFFFF))))

    return let(kept, entries)


def signature(text: Column) -> Column:
    """array<long> of the filled bins' entries; empty for a null text and one without words."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]{1,%d}" % MOST), F.lit(0))
    return let(words, lambda w: let(_kmers(w), lambda s: let(F.sort_array(_numbered(s)), _tuples)))


def fingerprint(entries: Column) -> Column:
    return F.array_join(F.transform(entries, lambda e: F.lpad(F.lower(F.hex(e)), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Bins that agree, of those that either fills; 1 where neither fills any."""
    bins = lambda x: F.transform(x, lambda e: F.shiftright(e, 32))
    filled = F.size(F.array_union(bins(a), bins(b)))
    return F.when(filled == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / filled)


def _below(value: Column, cuts: list[int], equal: bool) -> Column:
    """How many of the sorted ``cuts`` are below ``value``, or equal to it if asked, by a search in steps of STEP."""
    under = (lambda c: c <= value) if equal else (lambda c: c < value)
    level, levels = cuts, []
    while len(level) > STEP:
        levels.append(level)
        level = level[::STEP]
    listed = lambda x: F.from_json(F.lit(str(x)), "array<bigint>")
    at = F.size(F.filter(listed(level), under))
    for finer in reversed(levels):
        # every STEP-th of the finer ones was compared; of those after the last that is under, the others
        first = F.greatest(at - 1, F.lit(0)) * STEP
        at = first + F.size(F.filter(F.slice(listed(finer), first + 1, F.lit(STEP)), under))
    return at


def with_runs(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` (doc_id, text, ...) with _tie, the text's hash, and _run, ascending with doc_id and _tie; and how many runs there are.

    Runs end at quantiles of the ids, so that they are of even size however the ids lie; an id that many rows share, or that
    is null, has several runs by the texts' hashes.
    """
    known, count = rows.agg(F.count("doc_id"), F.count("*")).first()
    runs, bare = (min(RUNS, max(1, n // RUN)) for n in (known, count - known))
    cuts: list[int] = []
    if runs > 1:
        shares = F.from_json(F.lit(str([i / runs for i in range(1, runs)])), "array<double>")
        cuts = sorted(rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * runs))).first()[0])
    tie = F.xxhash64("text")
    part = tie / float(1 << 64) + 0.5
    low, high = (_below(F.col("doc_id").cast("long"), cuts, equal) if cuts else F.lit(0) for equal in (False, True))
    run = F.when(F.col("doc_id").isNull(), F.floor(part * bare) - bare).otherwise(low + F.floor(part * (high - low + 1)))
    return rows.withColumn("_tie", tie).withColumn("_run", run.cast("long")), runs + bare


def with_next(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text, own) with next and following, the text and signature of the row after in ascending id; the first after the last.

    Null ids come first; of rows with one id, texts' hashes decide. Rows are dealt by runs of neighbouring ids, the last row of a
    run takes the first of the next run that has any.
    """
    dealt, runs = with_runs(rows)
    leaders = dealt.groupBy("_run").agg(F.min(F.struct(F.col("doc_id"), F.col("_tie"))).alias("lead"))
    order = Window.orderBy("_run")
    after = F.coalesce(F.lead("lead").over(order), F.first("lead").over(order))
    leaders = leaders.select(F.col("_run").alias("_for"), after["doc_id"].alias("_id"), after["_tie"].alias("_at"))
    if runs <= BROADCAST_ROWS:
        leaders = F.broadcast(leaders)
    heads = dealt.drop("own").select(F.col("doc_id").alias("_d"), F.col("_tie").alias("_t"), F.col("text").alias("_text"))
    heads = heads.join(leaders, F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_at"))).groupBy(F.col("_for").alias("_run")).agg(F.first("_text").alias("_head"))
    heads = heads.withColumn("_signed", signature(F.col("_head")))
    inside = Window.partitionBy("_run").orderBy(F.col("doc_id").asc_nulls_first(), "_tie")
    out = dealt.withColumn("_lead", F.lead(F.struct("text", "own")).over(inside)).join(heads, "_run", "left")
    return out.select(*rows.columns, F.coalesce("_lead.text", "_head").alias("next"), F.coalesce("_lead.own", "_signed").alias("following"))


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points, rounded down, replaced by as many of the next text's first ones, or all it has."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def compare_edits(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) → doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    One row for each input row, repeated rows and ids included. A null text counts as empty: n_chars 0, fingerprint ''. Two texts
    without words have likeness 1. Texts of any length are signed whole. Equal texts have equal fingerprints. Other columns don't
    matter, whatever their names. An only row is followed by itself; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("own", signature(F.col("text"))))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited(F.col("text"), F.col("next")).alias("edit"), "own", "following")
    signed = rows.select("doc_id", "n_chars", F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"), "own", signature(F.col("edit")).alias("other"), "following")
    return signed.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
