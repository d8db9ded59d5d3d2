"""Document fingerprints by Order MinHash, with Spark expressions only.

The k-mers of a text are its runs of ``KMER`` units, numbered by occurrence, so a repeated k-mer counts as many
different ones. Units are words; a word of more than ``LONG_WORD`` characters, as in scripts without spaces, falls into
its characters. For each of ``SKETCHES`` random orders two minimal k-mers are selected, one from either half of the
hash space, kept in the order in which they stand in the text, and hashed as a pair. Texts that share k-mers in another
order agree less than texts an edit away, which is what sets this apart from MinHash. The likeness of two
fingerprints is the share of equal sketches.

Minima are taken by aggregation: k-mers are exploded and reduced within the task that holds the document, so one short
row per text is shuffled and no array of k-mers is.

The next document of the check comes from the descending order of ids. That order is found on ids alone: ranges of
ids are windows of their own, and the last id of a range meets the first of the next through a table of one row per range.

Cases: null text: empty. A text of fewer than ``KMER`` units is one k-mer of all of them; without any the
fingerprint is empty, and two empty ones have likeness 1. Repeated rows share a result; rows of one id with different
texts are ordered by text hash. A null id comes last. A single document follows itself. Empty table: no rows. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import let, stored, whole

KMER = 3
LONG_WORD = 32
SKETCHES = 32
#: A text of Spark has less than 2 ** 31 units, so places are never cut.
POSITION_BITS = 31


def kmers(text: Column) -> Column:
    """Occurrence-numbered k-mers of a text: structs of a hash ``h`` and the place ``i``, in any order."""
    words = F.split(F.btrim(text, F.lit(" \n\t\r")), r"[ \n\t\r]+", -1)
    cut = lambda w: F.flatten(F.transform(w, lambda x: F.when(F.char_length(x) > LONG_WORD, F.split(x, "")).otherwise(F.array(x))))
    units = let(words, lambda w: F.when(F.exists(w, lambda x: F.char_length(x) > LONG_WORD), cut(w)).otherwise(w))

    def numbered(order: Column) -> Column:
        # equal k-mers stand next to each other; the place in such a run is the occurrence
        starts = F.filter(F.sequence(F.lit(0), F.size(order) - 1), lambda k: (k == 0) | (F.get(order, k)["h"] != F.get(order, F.greatest(k - 1, F.lit(0)))["h"]))
        run = lambda s: F.flatten(F.transform(s, lambda k, at: F.transform(
            F.slice(order, k + 1, F.coalesce(F.get(s, at + 1), F.size(order)) - k),
            lambda x, n: F.struct(F.when(n == 0, x["h"]).otherwise(F.xxhash64(x["h"], n)).alias("h"), x["i"].alias("i")))))
        return let(starts, lambda s: F.when(F.size(s) == F.size(order), order).otherwise(run(s)))

    def of_words(w: Column) -> Column:
        last = F.size(w) - KMER
        plain = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(F.xxhash64(*[F.get(w, k + j) for j in range(KMER)]).alias("h"), k.alias("i")))
        short = F.array(F.struct(F.xxhash64(F.array_join(w, " ")).alias("h"), F.lit(0).alias("i")))
        none = F.array().cast("array<struct<h:bigint,i:int>>")
        return (F.when(last >= 0, let(F.sort_array(plain), numbered))
                .when((F.size(w) > 1) | (F.get(w, F.lit(0)) != ""), short).otherwise(none))

    return let(units, of_words)


def packed(h: Column, place: Column, sketch: int) -> Column:
    """A k-mer's rank in one order, with its place in the low bits: comparing the numbers compares the ranks."""
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(h, F.lit(sketch)), POSITION_BITS + 1), POSITION_BITS).bitwiseOR(
        F.least(place.cast("long"), F.lit((1 << POSITION_BITS) - 1)))


def fingerprints(texts: DataFrame, keys: list[str], sketches: int = SKETCHES) -> DataFrame:
    """``keys`` and ``fingerprint`` (hexadecimal, eight digits per sketch) for every row of ``keys`` and ``text``."""
    rows = texts.select(*keys, F.inline_outer(kmers(F.col("text"))).alias("__llm_h", "__llm_at"))
    h, at = F.col("__llm_h"), F.col("__llm_at")
    # one order from the bits of a second hash: both halves of the space, for each of the sketches
    half = F.when(h.bitwiseAND(F.lit(1)) == 0, True).otherwise(False)
    mins = []
    for k in range(sketches):
        rank = packed(h, at, k)
        mins += [F.min(F.when(half, rank)).alias(f"__llm_a{k}"), F.min(F.when(~half, rank)).alias(f"__llm_b{k}")]
    reduced = rows.groupBy(*keys).agg(*mins)
    mask = F.lit((1 << POSITION_BITS) - 1)

    def component(k: int) -> Column:
        a, b = F.col(f"__llm_a{k}"), F.col(f"__llm_b{k}")
        first = F.coalesce(a.bitwiseAND(mask) <= b.bitwiseAND(mask), F.lit(True))
        pair = F.xxhash64(F.shiftright(F.when(first, a).otherwise(b), POSITION_BITS), F.shiftright(F.when(first, b).otherwise(a), POSITION_BITS), first | a.isNull() | b.isNull())
        return F.when(a.isNull() & b.isNull(), F.lit("")).otherwise(F.lpad(F.hex(F.shiftrightunsigned(pair, 32)), 8, "0"))

    return reduced.select(*keys, F.concat(*[component(k) for k in range(sketches)]).alias("fingerprint"))


def likeness(a: str | Column, b: str | Column, sketches: int = SKETCHES) -> Column:
    """Share of equal sketches of two fingerprints; 1 for two empty ones, 0 for one."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    equal = sum(F.when(F.substring(a, 8 * k + 1, 8) == F.substring(b, 8 * k + 1, 8), 1).otherwise(0) for k in range(sketches))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(equal / F.lit(float(sketches)))


def successors(keys: DataFrame) -> DataFrame:
    """``(id, mark, next_id, next_mark)`` over distinct rows, descending by id, then mark; the last is followed by the first."""
    desc = [F.desc("id"), F.desc("mark")]
    dealt = stored(keys.repartitionByRange(*desc).withColumn("part", F.spark_partition_id()), "ids-by-range")
    inside = Window.partitionBy("part").orderBy(*desc)
    led = dealt.select("*", F.lead(F.struct("id", "mark")).over(inside).alias("next"))
    firsts = dealt.groupBy("part").agg(F.max(F.struct("id", "mark")).alias("first")).collect()  # one row per range
    parts = sorted(firsts, key=lambda r: r["part"])
    follow = [(r["part"], n["first"]["id"], n["first"]["mark"]) for r, n in zip(parts, parts[1:] + parts[:1])]
    then = F.broadcast(keys.sparkSession.createDataFrame(follow, "part int, then_id long, then_mark long"))
    return led.join(then, "part").select("id", "mark", F.coalesce("next.id", "then_id").alias("next_id"), F.coalesce("next.mark", "then_mark").alias("next_mark"))


def compared(docs: DataFrame, sketches: int = SKETCHES) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness; see the module text for the cases."""
    # a null id is the least
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), whole("text").alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    keys = rows.groupBy("id", "mark").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first(F.char_length("text")).alias("n_chars"))
    keys = stored(keys, "keys")
    nexts = stored(successors(keys.select("id", "mark")), "successors")
    # what every text gives to the one before it
    wanted = nexts.join(keys.select("id", "mark", "n_chars"), ["id", "mark"]).select(
        F.col("next_id").alias("id"), F.col("next_mark").alias("mark"), F.col("id").alias("for_id"), F.col("mark").alias("for_mark"),
        F.floor(F.col("n_chars") / 3).cast("int").alias("take"))
    whole_texts = rows.select("id", "mark", "text")
    # repeated rows give once; on the other side they only repeat minima
    given = (whole_texts.join(wanted, ["id", "mark"]).select(F.col("for_id").alias("id"), F.col("for_mark").alias("mark"),
                                                            F.left("text", F.col("take")).alias("given")).dropDuplicates(["id", "mark"]))
    n = F.char_length("text")
    both = whole_texts.join(given, ["id", "mark"]).select("id", "mark", "text", F.concat(F.left("text", n - F.floor(n / 3).cast("int")), "given").alias("edited"))
    versions = both.select("id", "mark", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")),
                                                          F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("v"))
    flat = versions.select("id", "mark", "v.kind", "v.text", F.when(F.col("v.kind") == 1, F.sha2("v.text", 256)).alias("sha"))
    prints = fingerprints(flat, ["id", "mark", "kind", "sha"], sketches)
    own = F.max(F.when(F.col("kind") == 0, F.col("fingerprint")))
    edited = F.max(F.when(F.col("kind") == 1, F.col("fingerprint")))
    wide = stored(prints.groupBy("id", "mark").agg(own.alias("fingerprint"), edited.alias("edited_fingerprint"), F.max("sha").alias("edited_sha256")), "fingerprints")
    after = wide.select(F.col("id").alias("next_id"), F.col("mark").alias("next_mark"), F.col("fingerprint").alias("__next"))
    out = (keys.join(wide, ["id", "mark"]).join(nexts, ["id", "mark"]).join(after, ["next_id", "next_mark"])
           .withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))))
    return out.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint",
                      likeness("fingerprint", "edited_fingerprint", sketches).alias("near_edited"), likeness("fingerprint", "__next", sketches).alias("near_next"))
