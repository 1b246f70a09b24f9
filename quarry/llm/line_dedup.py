"""Line dedup with a segment-partition edit join, in DataFrame functions only.

A line (text between line feeds) with a word in it is removed if an earlier line, by doc_id and then place, is equal to it or
within the allowed edits of it. Allowed, by the length of the shorter of the two in code points: none under 16, one under 32,
two from there on. All lines are judged on the input, and lines without a word always stay.

 - Equal lines meet in an aggregation on two 64-bit hashes, so a line that millions of documents share is one row a task.
 - A different line within t edits of a line of length n keeps one of that line's t + 1 even segments unchanged, at a place
   that the difference of lengths and the number of the segment bound (multi-match-aware selection). First occurrences put
   their segments into an index under (length, number, text) and probe it with their own substrings for lengths n, n - 1, n - 2.
 - Pairs that meet, and whose numbers of neighbouring characters have like parities, are verified by a banded bit-parallel automaton: for each number of edits one word holds a bit for each of
   the five diagonals, and a character moves all of them with shifts and masks.

Null text: no lines; it stays null. Empty text: nothing to remove. Rows that are equal in id and text are one document and are
treated alike; rows that share an id only are ordered by a hash of their text. Null ids come first. No rows: no rows. Columns
other than id and text pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import SPACES
from quarry.storage import discard, materialize

#: Lengths from which one and two edits are allowed.
ONE, TWO = 16, 32
MOST = 2
#: Lines under one key from which the key is split.
HOT = 1000
#: A hash without its top bit.
REST = 2**63 - 1


def allowed(length: Column) -> Column:
    return F.when(length < ONE, 0).when(length < TWO, 1).otherwise(2)


def _probes(shorter: int, edits: int) -> list[tuple[int, int, int, int, int]]:
    """(1, how much shorter the other line is, segments, number of the segment, shift) for each place where one of its segments can stand."""
    shifts = ((i, range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1)) for i in range(edits + 1))
    return [(1, shorter, edits + 1, i, s) for i, around in shifts for s in around]


def _plan(length: int) -> list[tuple[int, int, int, int, int]]:
    """What a line of this length enters into the index (0, 0, ...), and all it looks up: lines of at most its length within the edits allowed by theirs."""
    edits = 2 if length >= TWO else 1
    out = [(0, 0, edits + 1, i, 0) for i in range(edits + 1)]
    for shorter in range(MOST + 1):
        other = length - shorter
        if other >= TWO:
            out += _probes(shorter, 2)
        elif other >= ONE and shorter <= 1:
            out += _probes(shorter, 1)
    return out


def line_keys(lines: DataFrame) -> DataFrame:
    """hp, key for each segment that a line enters or looks up. lines has h, n and b (the line in four bytes a code point); hp is h with its top bit 1 for a look-up.

    The plan of a length is a literal, and one small expression makes the key of each of its rows: a line's keys in a single
    expression are too much code for the JVM to compile.
    """

    def literal(length: int) -> Column:
        return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("probe", "d", "parts", "i", "shift"), x, strict=True)]) for x in _plan(length)])

    n = F.col("n")
    plan = F.when(n >= TWO + MOST, literal(TWO + MOST))
    for length in (TWO + 1, TWO, ONE + 1, ONE):
        plan = plan.when(n >= length, literal(length))
    x = lines.select("h", "n", "b", F.explode(plan).alias("x")).select("h", "b", (n - F.col("x.d")).alias("m"), "x.probe", "x.parts", "x.i", "x.shift")
    base, short = F.expr("m div parts").cast("int"), F.col("parts") - F.col("m") % F.col("parts")
    x = x.select("h", "b", "m", "probe", "i", "shift", base.alias("base"), short.alias("short"))
    at = F.col("i") * F.col("base") + F.greatest(F.col("i") - F.col("short"), F.lit(0)) + F.col("shift")
    size = F.col("base") + (F.col("i") >= F.col("short")).cast("int")
    key = F.xxhash64("m", "i", F.substring("b", 4 * at + 1, 4 * size))
        # the mark stands in the last byte of the row's hash: the bytes before it repeat from row to row and compress
    return x.select(F.col("h").bitwiseAND(F.lit(REST)).bitwiseOR(F.when(F.col("probe") == 1, F.lit(-(2**63))).otherwise(F.lit(0).cast("long"))).alias("hp"), key.alias("key"))


def within(a: Column, b: Column, edits: Column) -> Column:
    """Whether two arrays of characters are within `edits` (0 to 2) of each other.

    State: five bits for each of zero, one and two edits; bit d + 2 says that the first i of a and the first i + d of b can be
    aligned. A character of a keeps the diagonals where b agrees, and takes from the word with one edit less: the same
    diagonal (replaced), the one above (left out), and from its new value the one below (put in).
    """
    band = 31

    def move(s: Column, same: Column) -> Column:
        r0, r1, r2 = s.bitwiseAND(F.lit(band)), F.shiftright(s, 5).bitwiseAND(F.lit(band)), F.shiftright(s, 10)
        n0 = r0.bitwiseAND(same)
        n1 = r1.bitwiseAND(same).bitwiseOR(r0).bitwiseOR(F.shiftright(r0, 1)).bitwiseOR(F.shiftleft(n0, 1)).bitwiseAND(F.lit(band))
        n2 = r2.bitwiseAND(same).bitwiseOR(r1).bitwiseOR(F.shiftright(r1, 1)).bitwiseOR(F.shiftleft(n1, 1)).bitwiseAND(F.lit(band))
        return n0.bitwiseOR(F.shiftleft(n1, 5)).bitwiseOR(F.shiftleft(n2, 10))

    def step(s: Column, i: Column) -> Column:
        same = sum((F.when(F.get(a, i) == F.get(b, i + d), 1 << (d + 2)).otherwise(0) for d in range(-MOST, MOST + 1)), F.lit(0))
        # an array of one binds the value: within a lambda every mention would compute it again
        return F.when(s == 0, s).otherwise(F.get(F.transform(F.array(same), lambda e: move(s, e)), F.lit(0)))

    start = 0b00100 | 0b01100 << 5 | 0b11100 << 10
    end = F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), F.lit(start), step)
    last = F.size(b) - F.size(a) + MOST
    bit = F.call_function("shiftright", F.call_function("shiftright", end, (5 * edits).cast("int")), last.cast("int")).bitwiseAND(F.lit(1)) == 1
    return F.when(F.abs(F.size(b) - F.size(a)) > edits, False).otherwise(bit)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _has_word(line: Column) -> Column:
    return line.rlike(f"[^{SPACES}]")


def _ids(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def first_lines(d: DataFrame) -> DataFrame:
    """h1, h2, doc_id, rid, pos and line of the first occurrence of each different line. d has doc_id, text and rid.

    The lines stand in the table, so that their keys are made without dealing out the texts beside them.
    """
    rows = d.select("doc_id", "rid", F.posexplode(_lines(F.col("text"))).alias("pos", "line")).where(_has_word(F.col("line")))
    found = rows.select("doc_id", "rid", "pos", "line", *_ids(F.col("line"))).groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "rid", "pos", "line")).alias("o"))
    return materialize(found.select("h1", "h2", "o.*"), "lines", compression="zstd")


def _at(d: DataFrame, lines: DataFrame, how: str = "inner", *more: str) -> DataFrame:
    """Rows of d with ps, the places of `lines` in the document in order (with `more` columns, structs); all joins with d share its keys, so it is dealt out once."""
    place = F.struct("pos", *more) if more else F.col("pos")
    places = lines.groupBy(F.col("rid").alias("r2"), F.col("doc_id").alias("d2")).agg(F.array_sort(F.collect_list(place)).alias("ps"))
    return d.join(places, (d["rid"] == F.col("r2")) & d["doc_id"].eqNullSafe(F.col("d2")), how)


def _parity(c: Column) -> Column:
    """A bit for each of 64 classes of neighbouring characters: whether their number is odd. An edit changes at most four."""
    return F.aggregate(F.sequence(F.lit(0), F.size(c) - 2), F.lit(0).cast("long"), lambda s, i: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(F.get(c, i), F.get(c, i + 1)), F.lit(64)).cast("int"))))


def _blocks(parity: Column) -> Column:
    """Parities cut into 4 * MOST + 1 blocks, numbered: of two that differ in at most 4 * MOST bits, one block is equal."""
    n = 4 * MOST + 1
    width = 64 // n
    cut = [F.call_function("shiftrightunsigned", parity, F.lit(i * width)) for i in range(n)]
    return F.array(*[(c if i == n - 1 else c.bitwiseAND(F.lit((1 << width) - 1))) + F.lit(i << 32) for i, c in enumerate(cut)])


def _chars(line: Column) -> Column:
    """Code points; split('') would part surrogate pairs."""
    return F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0))


def kept_lines(d: DataFrame, firsts: DataFrame) -> DataFrame:
    """doc_id, rid, pos of the first lines that don't stand later than another line within the allowed edits.

    Keys of one line only go at once. Lines that are left are fetched and compared under their shared keys; the parities keep
    what can't be within the edits from leaving that join, so a key with many unlike lines sends out few pairs. A key of more
    than HOT lines is split by blocks of the parities, one of which is equal in any pair within the edits.
    """
    line = firsts.select(F.col("h1").alias("h"), F.length("line").alias("n"), F.encode("line", "UTF-32").alias("b")).where(F.col("n") >= ONE)
    same, h, probe = Window.partitionBy("key"), F.col("hp").bitwiseAND(F.lit(REST)), (F.col("hp") < 0).cast("int")
    keys = line_keys(line).select("hp", "key", F.min(h).over(same).alias("low"), F.max(h).over(same).alias("high"), F.min(probe).over(same).alias("all_probe"))
    # by the hash without its top bit: should two lines agree in that, they get each other's keys too, which the check refuses
    shared = keys.where("low <> high AND all_probe = 0").groupBy(h.alias("h0")).agg(F.collect_set(F.struct("key", (probe == 1).alias("probes"))).alias("keys"))
    # a table, so that the shuffle files of all keys go before lines are fetched
    known = materialize(shared, "shared-keys")
    shared = firsts.drop("line").join(known, firsts["h1"].bitwiseAND(F.lit(REST)) == F.col("h0")).drop("h0")
    of = _at(d, shared, "inner", "keys").select("doc_id", "rid", "ps", _lines(F.col("text")).alias("ls"))
    of = of.select("doc_id", "rid", F.explode(F.transform("ps", lambda p: F.struct(p["pos"].alias("pos"), p["keys"].alias("keys"), F.get("ls", p["pos"]).alias("line")))).alias("x"))
    of = of.select(F.struct(F.struct("doc_id", "rid", "x.pos").alias("o"), *_ids(F.col("x.line"))).alias("at"), F.col("x.line").alias("line"), "x.keys", _chars(F.col("x.line")).alias("c"))
    # never null: else the join below infers a filter that computes it again, per element
    of = of.select("at", "line", "keys", F.coalesce(_parity(F.col("c")), F.lit(0).cast("long")).alias("parity"))
    # dealt out here, so that what stands above is computed once for its four readers
    of = of.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), "at")
    each = of.select("at", "parity", F.explode("keys").alias("k")).select("at", "parity", "k.key", "k.probes")
    hot = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select(F.col("key").alias("hot"))
    each = each.join(hot, F.col("key") == F.col("hot"), "left").select("at", "parity", "key", "probes", F.explode(F.when(F.col("hot").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(_blocks(F.col("parity")))).alias("block"))
    x = each.where("NOT probes").select("key", "block", F.col("at").alias("x"), F.col("parity").alias("pa"))
    y = each.where("probes").select("key", "block", F.col("at").alias("y"), F.col("parity").alias("pb"))
    like = (x["key"] == y["key"]) & (x["block"] == y["block"]) & (F.col("x") != F.col("y")) & (F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))) <= 4 * MOST)
    met = x.join(y, like).select("x", "y").distinct()  # a pair meets under several keys
    texts = of.select("at", "line")
    met = met.join(texts.select(F.col("at").alias("x"), F.col("line").alias("lx")), "x").join(texts.select(F.col("at").alias("y"), F.col("line").alias("ly")), "y")
    # a column that differs from run to run keeps the check out of the join, and the characters out of the check's lambdas
    met = met.select("x", "y", _chars(F.col("lx")).alias("ca"), _chars(F.col("ly")).alias("cb"), F.monotonically_increasing_id().alias("fence"))
    pairs = met.where(within(F.col("ca"), F.col("cb"), allowed(F.least(F.size("ca"), F.size("cb")))) & (F.col("fence") >= 0))
    near = pairs.select(F.greatest("x", "y").alias("z")).select("z.h1", "z.h2").distinct()
    # a table, so that the shuffle files of the pairs, the keys and the lines go before the texts are put together
    kept = materialize(firsts.drop("line").join(near, ["h1", "h2"], "left_anti").select("doc_id", "rid", "pos"), "near-lines")
    discard(known)
    return kept


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of docs with the lines removed from text, and __n_lines, __n_removed."""
    rest = [c for c in docs.columns if c not in (doc_id, text)]
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id), F.col(text)).alias("rid"), *([F.struct(*rest).alias("rest")] if rest else []))
    narrow = d.select("doc_id", "text", "rid")
    firsts = first_lines(narrow)
    kept = kept_lines(narrow, firsts)
    discard(firsts)
    out = _at(d, kept, "left").withColumn("ls", _lines(F.col("text")))
    blank = F.filter(F.transform("ls", lambda x, i: F.when(~_has_word(x), i)), lambda i: i.isNotNull())
    out = out.withColumn("stay", F.array_sort(F.concat(F.coalesce("ps", F.array().cast("array<int>")), blank)))
    new = F.array_join(F.transform("stay", lambda p: F.get("ls", p)), "\n")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("ls")).cast("long")
    columns = [F.col("doc_id").alias(doc_id) if c == doc_id else new.alias(text) if c == text else F.col("rest")[c].alias(c) for c in docs.columns]
    return out.select(*columns, n.alias("__n_lines"), F.when(F.col("text").isNull(), 0).otherwise(F.size("ls") - F.size("stay")).cast("long").alias("__n_removed"))


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the text that is left, in UTF-8; of nothing for null) for each row."""
    out = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with the lines removed from its texts; n_chars, if there is such a column, follows."""
    out = dedup(docs).drop("__n_lines", "__n_removed")
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
