"""Benchmark decontamination with DataFrame functions only.

A window is WINDOW consecutive words of a benchmark item, or the whole of a shorter item. Every run of n words holds an
aligned block of (n + 1) // 2 words, so a document is scanned by blocks: one hash for every fifth word when windows
have ten. Blocks meet the hash set of all block-long runs of the windows' words, which is broadcast if it is small.
Around a block that hits every window is compared, word by word, with the benchmark's, so hashes never decide. Hit words are then counted, and spans or documents removed.

Words are runs of bytes outside ASCII other than letters and digits, with A-Z lower-cased; the scan folds more (Unicode
lower case) so that it finds more, and the comparison decides.

Defined cases: a null or empty text has no words and is never contaminated; an item without words has no window;
repeated items count as items each, those that share an id as one; an empty benchmark hits nothing, an empty table of
documents has no rows; repeated rows get the same values each (rows that share an id get the hits of all of them: number
them first); a very long text is scanned whole, in time of its words and hits. Other columns are not read and come back
as they were; names that begin with two underscores are kept for the operators of this package.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.frames import only
from loomspark.plans.shared import saved

WINDOW = 10
#: Hashes that may be broadcast (about 40 bytes each in the hash relation); more are joined by a shuffle.
BROADCAST_HASHES = 1_000_000
#: Documents with hits whose spans may be broadcast (about 100 bytes each).
BROADCAST_SPANS = 100_000
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_APART_CASED = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: str | F.Column) -> F.Column:
    """Words in order, as written."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _APART_CASED), "")


def _exact(c: F.Column) -> F.Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def _loose(c: F.Column) -> F.Column:
    # lower() looks around a capital sigma; this doesn't
    return F.lower(F.replace(c, F.lit("Σ"), F.lit("σ")))


def _run(words: str, start: F.Column, n: F.Column | int) -> F.Column:
    return F.array_join(F.slice(F.col(words), start, n), " ")


def _loose_words(text: F.Column) -> F.Column:
    return F.array_remove(F.split(_loose(F.coalesce(text, F.lit(""))), _APART), "")


def _block_hashes(words: str, step: int, block: int) -> F.Column:
    """Hashes of the runs of block words that begin at each step-th word; by get(), as slice() in a lambda copies the whole array each time."""
    last = F.size(words) - block
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(block)]))


def benchmark_windows(benchmark: DataFrame, text: str = "text", id: str = "item_id", window: int = WINDOW) -> DataFrame:
    """item_id, n, gram: each item's distinct windows, words joined by a space."""
    items = benchmark.select(F.col(id).alias("item_id"), _words(text).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("n", F.least(F.size("w"), F.lit(window)))
    at = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1))
    rows = items.select("item_id", "n", "w", at.alias("i"))
    return rows.select("item_id", "n", _exact(_run("w", F.col("i"), F.col("n"))).alias("gram")).distinct()


def _checked(df: DataFrame, count: int, most: int = BROADCAST_HASHES) -> DataFrame:
    return F.broadcast(df) if count <= most else df


def hits(docs: DataFrame, windows: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, start (word, from 0), n, item_id: every occurrence of a window in a document, once."""
    windows = saved(windows, "windows")
    sizes = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most `window` values
    known = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    out = None
    for block in sorted({(n + 1) // 2 for n in sizes}):
        of = [n for n in sizes if (n + 1) // 2 == block]
        grams = windows.where(F.col("n").isin(of)).select(_loose_words(F.col("gram")).alias("w"))
        seeds = grams.select(F.explode_outer(_block_hashes("w", 1, block)).alias("hash")).where("hash is not null").distinct()
        rows = known.select("doc_id", _loose_words(F.col("text")).alias("w")).select("doc_id", _block_hashes("w", block, block).alias("hashes"))
        # explode_outer: for explode() the optimizer adds a filter that would split the text anew at each array element;
        # only ids and block numbers pass the join; the words come from the documents that have a hit
        near = rows.select("doc_id", F.posexplode_outer("hashes").alias("k", "hash")).join(_checked(seeds, seeds.count()), "hash")
        near = saved(near.groupBy("doc_id").agg(F.collect_set("k").alias("ks")), "blocks")
        words = only(known, near.select("doc_id"), "doc_id").distinct().join(near, "doc_id").select("doc_id", "ks", _words("text").alias("w"))
        for n in of:
            # a window that holds the block at word k * block begins at most n - block words before it
            first = F.flatten(F.transform("ks", lambda k: F.sequence(F.greatest(k * block - (n - block), F.lit(0)), k * block)))
            grown = F.transform(F.filter(F.array_distinct(first), lambda i: i + n <= F.size("w")), lambda i: F.struct(i.alias("start"), F.concat_ws(" ", *[F.get(F.col("w"), i + j) for j in range(n)]).alias("gram")))
            each = words.select("doc_id", F.explode_outer(grown).alias("x"))
            found = each.select("doc_id", F.col("x.start").cast("long").alias("start"), F.lit(n).alias("n"), _exact(F.col("x.gram")).alias("gram"))
            of_n = windows.where(F.col("n") == n).select("gram", "item_id")
            found = found.join(_checked(of_n, of_n.count()), "gram").select("doc_id", "start", "n", "item_id")
            out = found if out is None else out.unionByName(found)
    if out is None:
        return known.where("false").select("doc_id", F.lit(0).cast("long").alias("start"), F.lit(0).alias("n"), F.lit(None).cast(windows.schema["item_id"].dataType).alias("item_id"))
    return out.distinct()


def _merged(found: DataFrame) -> DataFrame:
    """doc_id, a, b: the hit words as ranges [a, b) that don't touch."""
    hit = found.select("doc_id", F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("b")).groupBy("doc_id", "a").agg(F.max("b").alias("b"))
    in_order = Window.partitionBy("doc_id").orderBy("a")  # of one text's hits
    begins = F.coalesce(F.col("a") > F.max("b").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    runs = hit.withColumn("begins", begins.cast("long")).withColumn("run", F.sum("begins").over(in_order))
    return runs.groupBy("doc_id", "run").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("run")


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    found = saved(hits(docs, benchmark_windows(benchmark, window=window), text, id), "hits")
    words = _merged(found).groupBy("doc_id").agg(F.sum(F.col("b") - F.col("a")).alias("n_hit"))
    items = found.select("doc_id", F.col("item_id").cast("string").alias("item")).distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    per = words.join(items, "doc_id")
    rows = docs.select(F.col(id).alias("doc_id"), F.size(_words(text)).cast("long").alias("n_words"))
    out = rows.join(per, "doc_id", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("items", F.array().cast("array<string>"))), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "spans", text: str = "text", id: str = "doc_id", window: int = WINDOW, max_share: float = 0.5) -> DataFrame:
    """docs without what the benchmark holds, in its own columns.

    mode "documents": rows with a hit go. mode "spans": the hit words and what stands between them go; a row of
    whose words more than max_share are hit goes as a whole.
    """
    found = saved(hits(docs, benchmark_windows(benchmark, window=window), text, id), "hits")
    names = docs.columns
    if mode == "documents":
        bad = found.select(F.col("doc_id").alias("__hit")).distinct()
        return docs.join(bad, F.col(id) == F.col("__hit"), "left_anti")
    if mode != "spans":
        raise ValueError("mode is documents or spans")
    spans = _merged(found).groupBy(F.col("doc_id").alias("__hit")).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("__spans"))
    # few are broadcast, so that clean texts stay where they are
    spans = saved(spans, "spans")
    few = _checked(spans, spans.count(), BROADCAST_SPANS)
    rows = docs.join(few, F.col(id) == F.col("__hit"), "left")
    # the text as words, and what stands before each and after the last
    words = _words(text)
    between = F.split(F.col(text), r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    share = F.aggregate("__spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"]) / F.size(words)
    # a sign for each word, 1 if it is hit: in time of the words and the spans together
    repeat = lambda sign, n: F.repeat(F.lit(sign), n.cast("int"))
    last = F.concat(F.array(F.lit(0).cast("long")), F.transform("__spans", lambda x: x["b"]))
    signs = F.zip_with("__spans", F.slice(last, 1, F.size("__spans")), lambda x, b: F.concat(repeat("0", x["a"] - b), repeat("1", x["b"] - x["a"])))
    signs = F.rpad(F.array_join(signs, ""), F.size(words), "0")
    # a kept word brings what stood after it, the first one also what stood before
    units = F.filter(F.arrays_zip(F.col("__words").alias("w"), F.slice("__gaps", 2, F.greatest(F.size("__words"), F.lit(1))).alias("gap"), F.split("__signs", "").alias("sign")), lambda x: x["sign"] == "0")
    rest = F.concat(F.when(F.col("__signs").startswith("0"), F.element_at("__gaps", 1)).otherwise(F.lit("")), F.array_join(F.transform(units, lambda x: F.concat(x["w"], x["gap"])), ""))
    dirty = rows.where("__spans is not null").where(share <= max_share)
    # written: else the optimizer would put the split into the lambda, once for each word
    dirty = saved(dirty.withColumns({"__words": words, "__gaps": between, "__signs": signs}), "dirty")
    dirty = dirty.withColumn(text, rest).select(*names)
    return rows.where("__spans is null").select(*names).unionByName(dirty)
