"""Secret scan in DataFrame functions only: base patterns, and sliding-window entropy of candidate strings.

Spans are code points, end exclusive. A pattern's matches and the text between them give all positions:
an end is the running sum of the lengths up to it. Entropy looks at candidate strings (runs of CANDIDATE):
each belongs to a character class (hex, upper, mixed), a window of WINDOW characters moves over it, and
the counts of its characters, PACKED to a 64-bit number, change by one in and one out; so does the sum of
c*log2(c), kept in whole numbers, from which the entropy follows. Stretches of windows at or above the
class's threshold are spans of kind `entropy`, unless the allow-list covers the candidate or a base span
already covers the stretch.

Time is linear in the text, also for one string of 10**6 characters or 10**5 matches in a text: candidates
and running sums go by blocks, because an array or a string grows by copying; nothing is evaluated again
for each element (`let` binds it); patterns have no group under a quantifier that can recurse.

Cases: a null or empty text has no span; documents are kept once per row, repeated rows too; other
columns are kept, whatever their names (but one named as the result is replaced); texts of any length are scanned whole;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key(?-i))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"(?i)passw|secret|token|api_?key"
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the same matches as of AKIA[A-Z0-9]+ with 18 characters: a shorter one ends where its run of characters ends
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 16
#: Least entropy, in bits a character, of a window of WINDOW characters, by class.
LEAST = {"hex": 2.9, "upper": 3.2, "mixed": 3.4}
#: Candidates that are no secrets. Each row: what must be found and what must not.
ALLOW = (
    (None, r"[^A-Za-z_/+=-]|[A-Za-z][A-Z]"),  # words, with joining marks
    (None, r"[^A-Z_/+=-]"),
    (None, r"[^0-9_/+=-]"),  # numbers
    (r"^[A-Za-z0-9]", r"[A-Za-z]{13}|[0-9]{13}|[A-Za-z][0-9]|[0-9][A-Za-z]|[_/+=-]{2}"),  # addresses of files: short parts, each of letters or of digits alone
    (r"(?i)example|placeholder|changeme|x{6}", None),  # stand-ins
    (r"(.)\1{7}", None),
)

BLOCK = 128  # elements of an array that are added up at a time
PIECE = 512  # characters of a candidate that are scanned at a time
CUT = 1024  # characters of a text that are looked up at a time
FIRST, PACKED, WIDTH = ord("+"), 12, 5  # cells from the code of + on, PACKED to a number, WIDTH bits each
CELLS = -(-(ord("z") - FIRST + 1) // PACKED)
#: c*log2(c) of counts, in units of 2**-32, and the step from c to c + 1.
NLOG = [0] + [round(c * math.log2(c) * 2**32) for c in range(1, WINDOW + 1)]
STEP = [b - a for a, b in zip(NLOG, NLOG[1:], strict=False)]
MOST = {k: math.floor((math.log2(WINDOW) - v) * WINDOW * 2**32) for k, v in LEAST.items()}

_SPAN = "array<struct<kind:int,start:int,end:int>>"


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array of whole numbers >= 0 under op (a sum or a maximum), in linear time: by blocks."""
    zero = F.struct(F.lit(0).alias("at"), _none("array<int>").alias("out"))

    def grow(acc: Column, x: Column) -> Column:
        return F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(op(acc["at"], x))).alias("out"))

    def shift(acc: Column, part: Column) -> Column:
        return F.struct(op(acc["at"], F.element_at(part, -1)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def parts(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, BLOCK))
        return F.transform(blocks, lambda x: F.aggregate(x, zero, grow, lambda acc: acc["out"]))

    def whole(p: Column) -> Column:
        return let(F.aggregate(p, zero, shift, lambda acc: acc["out"]), lambda before: F.flatten(F.transform(p, lambda x, i: F.transform(x, lambda y: op(F.get(before, i), y)))))

    return let(values, lambda v: F.when(F.size(v) > 0, let(parts(v), whole)).otherwise(_none("array<int>")))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _positions(text: Column, pattern: str) -> Column:
    """Matches as array<struct<text, start, end>>."""
    # the pieces between matches, each with the match after it: the last has none
    both = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))

    def placed(x: Column) -> Column:
        ends = _running(F.transform(x, lambda y: F.char_length(y["piece"]) + F.coalesce(F.char_length(y["match"]), F.lit(0))), _sum)
        return F.zip_with(x, ends, lambda y, end: F.struct(y["match"].alias("text"), (end - F.char_length(y["match"])).alias("start"), end.alias("end")))

    return F.filter(let(both, placed), lambda y: y["text"].isNotNull())


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def _allowed(s: Column) -> Column:
    out = F.lit(False)
    for has, lacks in ALLOW:
        one = s.rlike(has) if has else F.lit(True)
        out = out | (one & ~s.rlike(lacks) if lacks else one)
    return out


def _windows(s: Column) -> Column:
    """Of a candidate: a text with 1 for each of its windows at or above the class's threshold and 0 for others."""
    most = F.when(~s.rlike("[^0-9a-f]"), MOST["hex"]).when(~s.rlike("[^A-Z0-9]"), MOST["upper"]).otherwise(MOST["mixed"])
    step = F.array(*[F.lit(x) for x in STEP])
    zero = F.struct(F.array(*[F.lit(0).cast("long")] * CELLS).alias("cells"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"), F.lit("").alias("out"))

    def count(acc: Column, x: Column, name: str) -> Column:
        return F.call_function("shiftrightunsigned", F.get(acc["cells"], x[f"{name}_at"]), x[f"{name}_by"]).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")

    def move(most_: Column):
        def one(acc: Column, x: Column) -> Column:
            came = F.get(step, count(acc, x, "new") - x["same"])
            left = F.coalesce(F.get(step, count(acc, x, "old") - 1), F.lit(0))
            cells = F.transform(acc["cells"], lambda c, j: c + F.when(j == x["new_at"], x["new_one"]).otherwise(F.lit(0)) - F.when(j == x["old_at"], x["old_one"]).otherwise(F.lit(0)))
            total = acc["sum"] + came - left
            out = F.when(acc["n"] < WINDOW - 1, acc["out"]).when(total <= most_, F.concat(acc["out"], F.lit("1"))).otherwise(F.concat(acc["out"], F.lit("0")))
            return F.struct(cells.alias("cells"), total.alias("sum"), (acc["n"] + 1).alias("n"), out.alias("out"))

        return one

    def scan(piece: Column, before: Column, most_: Column) -> Column:
        chars = F.split(F.concat(F.coalesce(F.substring(before, PIECE - WINDOW + 2, WINDOW - 1), F.lit("")), piece), "")

        def moves(a: Column) -> Column:
            def x(c: Column, i: Column) -> Column:
                old = F.get(a, i - WINDOW)
                return F.struct(*_cell(c, "new"), *_cell(old, "old"), F.when(c == old, 1).otherwise(0).alias("same"))

            return F.aggregate(F.transform(a, x), zero, move(most_), lambda acc: acc["out"])

        return let(chars, moves)

    pieces = F.regexp_extract_all(s, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return let(most, lambda m: let(pieces, lambda p: F.array_join(F.transform(p, lambda x, i: scan(x, F.get(p, i - 1), m)), "")))


def _cell(c: Column, name: str) -> list[Column]:
    """Where a character is counted: which number, by how many bits, and one there."""
    code = F.ascii(c) - FIRST
    by = code % PACKED * WIDTH
    return [F.floor(code / PACKED).cast("int").alias(f"{name}_at"), by.alias(f"{name}_by"), F.call_function("shiftleft", F.lit(1).cast("long"), by).alias(f"{name}_one")]


def _hot(s: Column) -> Column:
    """Of a candidate: array<struct<start, end>>, stretches of its hot windows, put together where they touch."""
    found = _positions(_windows(s), f"1(?:0{{0,{WINDOW - 1}}}+1)*+")
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), (x["end"] + WINDOW - 1).alias("end")))


def _fresh(docs: DataFrame, name: str) -> str:
    """name, with marks before it until no column of docs has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _uncovered(spans: Column) -> Column:
    """spans without those of kind entropy that lie in one of another kind, by start, then kind."""
    # in this order, what covers a span comes before it
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("less"), x["kind"].alias("kind"))))

    def kept(s: Column) -> Column:
        reach = _running(F.transform(s, lambda x: F.when(x["kind"] < 3, -x["less"]).otherwise(0)), F.greatest)
        return F.filter(F.zip_with(s, reach, lambda x, r: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), (-x["less"]).alias("end"), r.alias("reach"))), lambda x: (x["kind"] < 3) | (x["reach"] < x["end"]))

    return F.transform(F.array_sort(let(order, kept)), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def find_secrets(docs: DataFrame, name: str = "spans") -> DataFrame:
    """docs (doc_id, text, any others) with the column `name` (in place of one of that name): array<struct<kind, start, end>> sorted by start, then kind (an index into KINDS)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = _none(_SPAN)
    assign = F.zip_with(_positions(text, ASSIGN), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda x, v: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.char_length(v).alias("n")))
    odd = F.filter(_positions(text, CANDIDATE), lambda x: ~_allowed(x["text"]))
    hot = F.flatten(F.transform(odd, lambda x: F.transform(_hot(x["text"]), lambda h: F.struct(F.lit(3).alias("kind"), (x["start"] + h["start"]).alias("start"), (x["start"] + h["end"]).alias("end")))))
    spans = F.concat(
        F.when(text.rlike(ASSIGN_HINT), _spans(F.filter(assign, lambda x: x["n"] >= 12), 0)).otherwise(none),
        F.when(text.contains("AKIA"), _spans(_positions(text, ACCESS), 1)).otherwise(none),
        F.when(text.rlike(HEX), _spans(_positions(text, HEX), 2)).otherwise(none),
        F.when(text.rlike(CANDIDATE), hot).otherwise(none),
    )
    return docs.withColumn(name, let(spans, lambda s: F.when(F.size(s) > 0, _uncovered(s)).otherwise(none)))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _redacted(text: Column, spans: Column) -> Column:
    """text with each group of overlapping spans replaced by one mark. Parts of it are looked up in cuts of CUT characters."""

    def between(cuts: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / CUT).cast("int"), F.floor(b / CUT).cast("int")
        head = F.substring(F.get(cuts, first), a % CUT + 1, F.lit(CUT))
        tail = F.coalesce(F.substring(F.get(cuts, last), F.lit(1), b % CUT), F.lit(""))
        far = F.concat(F.coalesce(head, F.lit("")), F.array_join(F.slice(cuts, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), tail)
        return F.when(first == last, F.coalesce(F.substring(F.get(cuts, first), a % CUT + 1, b - a), F.lit(""))).otherwise(far)

    def grouped(s: Column) -> Column:
        def ends(reach: Column) -> Column:
            starts = F.filter(F.transform(s, lambda x, i: F.when(F.coalesce(x["start"] >= F.get(reach, i - 1), F.lit(True)), x["start"])), lambda x: x.isNotNull())
            stops = F.filter(F.transform(reach, lambda r, i: F.when(F.coalesce(F.get(s, i + 1)["start"] >= r, F.lit(True)), r)), lambda x: x.isNotNull())
            return F.arrays_zip(starts.alias("start"), stops.alias("end"))

        return let(_running(F.transform(s, lambda x: x["end"]), F.greatest), ends)

    def built(groups: Column) -> Column:
        n = F.char_length(text)
        cuts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
        before = lambda c, i: F.coalesce(F.get(groups, i - 1)["end"], F.lit(0))
        return let(cuts, lambda c: F.concat(F.array_join(F.transform(groups, lambda g, i: F.concat(between(c, before(c, i), g["start"]), F.lit("[secret]"))), ""), between(c, F.element_at(groups, -1)["end"], n)))

    return let(let(spans, grouped), built)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of `text` replaced by `[secret]` (overlapping spans by one); null texts stay null."""
    text, name = F.col("text"), _fresh(docs, "spans")
    return find_secrets(docs, name).withColumn("text", F.when(F.size(name) > 0, _redacted(text, F.col(name))).otherwise(text)).drop(name)


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    got = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return got.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(listed(F.filter("spans", lambda x: x["kind"] < 3)).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
