"""Benchmark decontamination by template windows, in DataFrame functions only.

Texts become tokens (runs of letters and digits, in lower case) and those templates: numbers, units after
numbers and names (capitalised words inside a sentence) count as typed placeholders. Windows of WINDOW
template tokens are joined by hash with those of the benchmark (items shorter than WINDOW: one window of
all their tokens). A window with names also counts with its names as plain words, so that a copy in other
letter case is met. Matches of a document and an item on one diagonal (document position less item
position) make a run, and unbroken positions in it a stretch. The values at placeholders tell a verbatim
copy (all equal) from a re-parameterised one (each value of the item stands for one value in the document);
values that contradict each other make no match: of such a run only its consistent stretches are left.
Runs of all diagonals are put together, largest first, as long as their values agree. A document is
contaminated by an item when these cover at least COVER of the item's tokens, or when a consistent stretch
has at least LONG tokens.

Plan: one pass over the documents. Only windows all of whose template tokens the benchmark has, too, are hashed
and exploded (with a benchmark of more than VOCABULARY such tokens: all windows), with nothing but doc_id,
position, hash and the few placeholders' values. They meet the benchmark's windows in a hash join:
those are broadcast when they are at most BROADCAST with at most BROADCAST_BYTES of values (measured first)
and shuffled otherwise.

Cases: null and empty texts match nothing, nor do items without tokens; repeated documents and items give
one row for each doc_id and item_id; rows with a null id on either side are left out; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

WINDOW, COVER, LONG = 8, 0.5, 13
BROADCAST, BROADCAST_BYTES = 200_000, 16 << 20  # windows, and bytes of their placeholders' values
VOCABULARY = 50_000  # different template tokens of the benchmark: with more, all windows are hashed
#: Units that count as placeholders after a number.
UNITS = (
    "kg g mg lb lbs oz km m cm mm mi mile miles ft feet inch inches l ml liter liters litre litres "
    "h hr hrs hour hours min mins minute minutes s sec secs second seconds day days week weeks month months year years "
    "percent dollar dollars euro euros cent cents usd eur kwh w kw v hz kmh mph"
).split()
_NUMBER, _UNIT, _NAME, _INNER = "\u0001", "\u0002", "\u0003", "\u0004"


def _tokens(rows: DataFrame) -> DataFrame:
    """rows with `own`: tokens of `text` in lower case, a name with a mark before it, marks inside numbers kept."""
    steps = (
        # each begins with a plain character class, so that most positions are passed over at once
        (rf"[{_NUMBER}-{_INNER}]", " "),
        (r"\p{Lu}(?<=[\p{Ll}\p{Nd},;:]\s\p{Lu})\p{Ll}+", f"{_NAME}$0"),
        (r"[.,:](?<=\p{Nd}[.,:])(?=\p{Nd})", _INNER),
        (r"\p{Nd}(?=\p{L})", "$0 "),
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return rows.withColumn("own", F.array_remove(F.split(F.lower(text), rf"[^\p{{L}}\p{{N}}{_NAME}{_INNER}]+"), "")).drop("text")


def _is_number(w: Column) -> Column:
    return (w >= "0") & (w < ":")


def _templates(rows: DataFrame) -> DataFrame:
    """rows (own) with `tmpl`: the hash of each template token, `folded`: the same with names as words (null if there are none), and `slotted`: whether there are placeholders."""
    mark = {c: F.xxhash64(F.lit(c)) for c in (_NUMBER, _UNIT, _NAME)}

    def unit(w: Column, i: Column) -> Column:
        return w.isin(UNITS) & F.coalesce(_is_number(F.get("own", i - 1)), F.lit(False))

    def template(w: Column, i: Column) -> Column:
        return F.when(_is_number(w), mark[_NUMBER]).when(w.startswith(_NAME), mark[_NAME]).when(unit(w, i), mark[_UNIT]).otherwise(F.xxhash64(w))

    def fold(w: Column, i: Column) -> Column:
        word = F.translate(w, _NAME, "")
        return F.when(~w.startswith(_NAME), F.get("tmpl", i)).when(unit(word, i), mark[_UNIT]).otherwise(F.xxhash64(word))

    got = rows.withColumn("tmpl", F.transform("own", template)).withColumn("n", F.size("own"))
    got = got.withColumn("folded", F.when(F.array_contains("tmpl", mark[_NAME]), F.transform("own", fold)))
    return got.withColumn("slotted", F.arrays_overlap("tmpl", F.array(*mark.values())))


def _vocabulary(items: DataFrame) -> str | None:
    """The hashes of all template tokens of items, as a list in SQL; None if there are more than VOCABULARY of them."""
    tokens = items.select(F.explode(F.concat("tmpl", F.coalesce("folded", F.expr("cast(array() as array<bigint>)")))).alias("h")).distinct()
    found = sorted(r.h for r in tokens.limit(VOCABULARY + 1).collect())
    return ", ".join(f"{h}L" if h > -(1 << 63) else "(-9223372036854775807L - 1L)" for h in found) or "0L" if len(found) <= VOCABULARY else None


def _starts(tokens: str, k: int, vocabulary: str) -> Column:
    """Positions in an array of hashes from which on k are in the vocabulary: between the ends and those that are not."""
    # of each token its position, or null if it is known (a hash set is asked); the ends are unknown
    odd = F.expr(f"filter(transform({tokens}, (h, i) -> if(h IN ({vocabulary}), null, i)), i -> i IS NOT NULL)")
    gaps = let(F.concat(F.array(F.lit(-1)), odd, F.array(F.size(tokens))), lambda v: F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: F.struct((a + 1).alias("from"), (b - k).alias("to"))))
    return F.flatten(F.transform(F.filter(gaps, lambda g: g["from"] <= g["to"]), lambda g: F.sequence(g["from"], g["to"])))


def _windows(rows: DataFrame, key: str, sizes: list[int], vocabulary: str | None = None) -> DataFrame:
    """key, n, size, pos, hash and slots (values at placeholders, in order; null if there are none) of each window of as many tokens as sizes say
    (with a vocabulary: of its tokens alone), those with names in both forms. One pass: rows are not filtered by their tokens, which would be made twice."""
    mark = {c: F.xxhash64(F.lit(c)) for c in (_NUMBER, _UNIT, _NAME)}

    def slots(tokens: str, i: Column, k: int) -> Column:
        pairs = F.arrays_zip(F.slice(tokens, i + 1, k).alias("t"), F.slice("own", i + 1, k).alias("w"))
        return F.filter(pairs, lambda x: x["t"].isin(*mark.values()))

    def window(i: Column, tokens: str, k: int, values: Column) -> Column:
        return F.struct(F.lit(k).alias("size"), i.alias("pos"), F.xxhash64(F.slice(tokens, i + 1, k), F.lit(k)).alias("hash"), values.alias("slots"))

    def at(tokens: str, k: int) -> Column:
        if vocabulary:
            return _starts(tokens, k, vocabulary)
        return F.when(F.col("n") >= k, F.sequence(F.lit(0), F.col("n") - k)).otherwise(F.expr("cast(array() as array<int>)"))

    def made(k: int) -> Column:
        own = F.transform(at("tmpl", k), lambda i: window(i, "tmpl", k, F.when(F.col("slotted"), F.transform(slots("tmpl", i, k), lambda x: x["w"]))))
        named = F.filter(at("folded", k), lambda i: F.array_contains(F.slice("tmpl", i + 1, k), mark[_NAME]))
        plain = F.transform(named, lambda i: window(i, "folded", k, F.transform(slots("folded", i, k), lambda x: F.translate(x["w"], _NAME, ""))))
        return F.when(F.col("folded").isNull(), own).otherwise(F.concat(own, plain))

    got = rows.select(key, "n", F.explode(F.concat(*map(made, sizes))).alias("x"))
    return got.select(key, "n", F.col("x.size").alias("size"), F.col("x.pos").alias("pos"), F.col("x.hash").alias("hash"), F.when(F.size("x.slots") > 0, F.col("x.slots")).alias("slots"))


def _agree(values: Column) -> Column:
    """Whether each value of the item stands for one value in the document; values without repeats."""
    return F.size(F.array_distinct(F.transform(values, lambda x: x["iv"]))) == F.size(values)


def _runs(hits: DataFrame) -> DataFrame:
    """Consistent runs: spans (first and last item position of each stretch), values and doc_start, a row for each doc_id, item_id, size, n_item, spans and values."""
    values = F.when(F.col("slots").isNotNull(), F.arrays_zip(F.col("item_slots").alias("iv"), F.col("slots").alias("v")))
    spots = F.collect_set(F.struct("ipos", values.alias("values")))
    runs = hits.groupBy("doc_id", "item_id", "size", "n_item", (F.col("pos") - F.col("ipos")).alias("diagonal")).agg(spots.alias("spots"))
    runs = runs.withColumn("at", F.array_sort(F.array_distinct(F.transform("spots", lambda x: x["ipos"]))))
    first = F.filter("at", lambda x, i: F.coalesce(F.get("at", i - 1) < x - 1, F.lit(True)))
    last = F.filter("at", lambda x, i: F.coalesce(F.get("at", i + 1) > x + 1, F.lit(True)))
    runs = runs.withColumn("spans", F.arrays_zip(first.alias("from"), last.alias("to")))

    def within(low: Column, high: Column) -> Column:
        got = F.filter("spots", lambda x: (x["ipos"] >= low) & (x["ipos"] <= high) & x["values"].isNotNull())
        return F.array_sort(F.array_distinct(F.flatten(F.transform(got, lambda x: x["values"]))))

    def run(spans: Column, low: Column, high: Column) -> Column:
        return F.struct(spans.alias("spans"), within(low, high).alias("values"), (low + F.col("diagonal")).alias("doc_start"))

    runs = runs.withColumn("whole", run(F.col("spans"), F.array_min("at"), F.array_max("at")))
    parts = F.filter(F.transform("spans", lambda x: run(F.array(x), x["from"], x["to"])), lambda r: _agree(r["values"]))
    runs = runs.select("doc_id", "item_id", "size", "n_item", F.explode(F.when(_agree(F.col("whole.values")), F.array("whole")).otherwise(parts)).alias("r"))
    return runs.select("doc_id", "item_id", "size", "n_item", "r.*").groupBy("doc_id", "item_id", "size", "n_item", "spans", "values").agg(F.min("doc_start").alias("doc_start"))


def _positions(spans: Column, more: Column | int = 0) -> Column:
    """Item positions of the spans, each lengthened by more."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda x: F.sequence(x["from"], x["to"] + more))))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: float = COVER, long: int = LONG) -> DataFrame:
    """doc_id, item_id, doc_start, item_start, n_windows, coverage and verbatim (false: re-parameterised) of each contaminated document and item."""
    items = _templates(_tokens(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL")))
    short = sorted(r[0] for r in items.filter((F.col("n") > 0) & (F.col("n") < window)).select("n").distinct().collect())  # at most window - 1 numbers
    rows = _templates(_tokens(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")))
    bench = _windows(items, "item_id", [window])
    for k in short:
        bench = bench.unionByName(_windows(items.filter(F.col("n") == k), "item_id", [k]))
    spots = _windows(rows, "doc_id", [window, *short], _vocabulary(items))
    bench = bench.select("hash", "size", "item_id", F.col("pos").alias("ipos"), F.col("n").alias("n_item"), F.col("slots").alias("item_slots")).dropDuplicates(["item_id", "hash", "size", "ipos"])
    size = bench.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.array_join("item_slots", ""))), F.lit(0)).alias("bytes")).first()
    if size["n"] <= BROADCAST and size["bytes"] <= BROADCAST_BYTES:
        bench = F.broadcast(bench)  # measured above

    runs = _runs(spots.drop("n").join(bench, ["hash", "size"]))
    n_run = F.size(_positions(F.col("spans")))
    one = F.struct((-n_run).alias("less"), "doc_start", "spans", "values")
    longest = F.max(F.array_max(F.transform("spans", lambda x: x["to"] - x["from"])) + F.col("size"))
    pairs = runs.groupBy("doc_id", "item_id", "size", "n_item").agg(F.array_sort(F.collect_list(one)).alias("runs"), longest.alias("longest"))

    def add(acc: Column, x: Column) -> Column:
        values = F.array_union(acc["values"], x["values"])
        more = F.struct(F.least(acc["doc_start"], x["doc_start"]).alias("doc_start"), F.array_union(acc["spans"], x["spans"]).alias("spans"), values.alias("values"))
        return F.when(_agree(values), more).otherwise(acc)

    rest = F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0)))
    start = F.struct(F.col("runs")[0]["doc_start"].alias("doc_start"), F.col("runs")[0]["spans"].alias("spans"), F.col("runs")[0]["values"].alias("values"))
    pairs = pairs.withColumn("u", F.aggregate(rest, start, add))
    pairs = pairs.withColumn("coverage", F.size(_positions(F.col("u.spans"), F.col("size") - 1)) / F.col("n_item")).filter((F.col("coverage") >= cover) | (F.col("longest") >= long))
    found = F.struct(
        F.col("u.doc_start").alias("doc_start"), F.array_min(F.transform("u.spans", lambda x: x["from"])).alias("item_start"), F.size(_positions(F.col("u.spans"))).cast("long").alias("n_windows"), "coverage", F.forall("u.values", lambda x: x["iv"] == x["v"]).alias("verbatim")
    )
    best = pairs.groupBy("doc_id", "item_id").agg(F.max_by(found, F.struct("coverage", -F.col("u.doc_start"), "size", found)).alias("b"))
    return best.select("doc_id", "item_id", "b.*")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
