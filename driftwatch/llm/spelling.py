"""Spelling variants by a bit-sliced position index.

Words are near if one inserted, deleted or replaced code point makes them equal. Let L be the length of the shorter word and e the length of what
the two have in common in front: then they agree before e, and behind the edit at e up to the end. The places 0..L are cut into gaps (two at first), and a word is filed, for
each gap, under what it has in front of and behind it; it is filed for L its own length and for L one less, as the longer word. A near pair is
looked for in the gap that holds e only, so it comes once. A key with too many words is filed again with its gap cut
in halves until it has few: a gap of one place leaves one differing letter (two in longer words), so that ends.

In a key, words differ within the gap only. Of these middles, an index has a bitset over the key's words for each
(place, letter). For each word, recurrences over its letters keep the sets of words that agree so far without error, and with one: replaced (same
place), longer (place shifted up) or shorter (shifted down). Bits are in the order of falling counts, then of the words, so the lowest bit of the last set is the
best near word and the number of bits is the number of near words: no pair is ever listed.

A null text has no words; a null id counts as the empty one in the hash. Documents of equal id are counted each. Ties go to the smaller word in code-point order.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.session import materialize

LOWERED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Most words of a key whose gap can still be cut.
LARGE = 1 << 13
FILED = "L int, s int, t int, key string, middle string, n long, word string"
NEAR = "word string, n_near long, best_n long, best string"


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = 5, least: int = 3, noise: int = 97) -> DataFrame:
    """``word`` and ``n``: runs of Latin letters with A-Z lower-cased, of at least ``least_chars`` code points, found at least ``least`` times in all.

    With h the crc32 of ``<doc_id>:<run>``, a run loses its code point ``h % length`` in documents where ``noise`` divides h. Words are added up in
    each batch before the shuffle.
    """
    run = re.compile(rf"[A-Za-zÀ-ÿ]{{{least_chars},}}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[str] = Counter()
            for own, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                prefix = crc32(f"{'' if own is None else own}:".encode())
                for word, n in Counter(run.findall((value or b"").translate(LOWERED).decode())).items():
                    h = crc32(word.encode(), prefix)
                    if h % noise == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_chars:
                            continue
                    seen[word] += n
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    parts = docs.select(F.col(doc_id).cast("string"), text).mapInArrow(counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _filed(words: DataFrame) -> DataFrame:
    """Words under their keys: gap [s, t) of the shorter length L, what is before and behind it, and the middle."""
    size = F.length("word")
    lengths = F.array(size, size - 1)
    each = words.select("word", "n", F.explode(lengths).alias("L")).select("*", F.floor(F.col("L") / 2).cast("int").alias("m"))
    gaps = F.array(F.struct(F.lit(0).alias("s"), F.col("m").alias("t")), F.struct(F.col("m").alias("s"), F.col("L").alias("t")))
    return _keyed(each.select("word", "n", "L", F.explode(gaps).alias("g")).select("word", "n", "L", "g.s", "g.t").where("t > s"))


def _keyed(rows: DataFrame) -> DataFrame:
    behind = F.col("L") - F.col("t")
    ahead = F.substring("word", F.lit(1), F.col("s"))
    tail = F.substring("word", F.length("word") - behind + 1, behind)
    middle = F.substring("word", F.col("s") + 1, F.length("word") - F.col("s") - behind)
    return rows.select("L", "s", "t", F.concat(ahead, F.lit(" "), tail).alias("key"), middle.alias("middle"), "n", "word")


def _halved(rows: DataFrame) -> DataFrame:
    """Rows filed again in the halves of their gaps."""
    half = F.floor((F.col("s") + F.col("t")) / 2).cast("int")
    gaps = F.array(F.struct(F.col("s").alias("a"), half.alias("b")), F.struct(half.alias("a"), F.col("t").alias("b")))
    return _keyed(rows.select("word", "n", "L", F.explode(gaps).alias("g")).select("word", "n", "L", F.col("g.a").alias("s"), F.col("g.b").alias("t")))


def _split(filed: DataFrame, large: int) -> DataFrame:
    """Rows filed such that no key holds over ``large`` words, unless its gap is one place. Each pass halves the gaps of those that do."""
    done: list[DataFrame] = []
    now = filed
    by = ["L", "s", "t", "key"]
    while True:
        crowded = now.groupBy(*by).agg(F.count("*").alias("_k")).where((F.col("_k") > large) & (F.col("t") - F.col("s") > 1)).drop("_k")
        crowded = materialize(crowded, "spelling-crowded")
        if crowded.isEmpty():
            break
        done.append(now.join(crowded, by, "left_anti"))
        now = materialize(_halved(now.join(crowded, by, "left_semi")), "spelling-filed")
    for part in done:
        now = now.unionByName(part)
    return now


def near_sets(middles: list[str], short: int, last: bool) -> Iterator[tuple[int, int]]:
    """Each middle's place and the bitset of its near ones, for those that have any. Middles have ``short`` letters or one more.

    Two of ``short`` letters are near if one is replaced; one of each length if one is inserted, not at the end unless the gap is the ``last``.
    """
    index: list[dict[str, int]] = [{} for _ in range(short + 1)]
    shorter = 0
    for i, middle in enumerate(middles):
        for place, letter in enumerate(middle):
            index[place][letter] = index[place].get(letter, 0) | 1 << i
        if len(middle) == short:
            shorter |= 1 << i
    longer = (1 << len(middles)) - 1 & ~shorter
    for i, middle in enumerate(middles):
        if len(middle) == short:
            exact, replaced, grown = shorter | longer, 0, 0
            for place, letter in enumerate(middle):
                here = index[place].get(letter, 0)
                grown = (grown | exact) & index[place + 1].get(letter, 0)
                replaced = replaced & here | exact & ~here
                exact &= here
            grown = grown | exact if last else grown & ~exact
            near = replaced & shorter | grown & longer
        else:
            exact, shrunk = shorter, 0
            for place, letter in enumerate(middle):
                shrunk = (shrunk & index[place - 1].get(letter, 0) if place else 0) | exact
                exact &= index[place].get(letter, 0) if place < short else 0
                if place == short - 1 and not last:
                    equal = exact  # the shorter word is this one's beginning: the pair belongs to the gap behind
            near = shrunk & ~equal if short and not last else shrunk
        if near:
            yield i, near


def _near_in_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of near words and the best of them, by word and key. Rows are sorted by key, then falling n, then word; one key's rows are held at a time."""
    names = [x.split(" ")[0] for x in NEAR.split(", ")]

    def found(rows: list[tuple]) -> Iterator[tuple]:
        size, s, t = rows[0][:3]
        for i, near in near_sets([r[4] for r in rows], t - s, t == size):
            best = rows[(near & -near).bit_length() - 1]
            yield rows[i][6], near.bit_count(), best[5], best[6]

    def made(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names)

    held: list[tuple] = []
    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:4] != held[-1][:4]:
                out += found(held) if len(held) > 1 else ()
                held = []
            held.append(row)
        yield made(out)
    if len(held) > 1:
        yield made([*found(held)])


def near_words(words: DataFrame, large: int = LARGE) -> DataFrame:
    """``word``, ``n_near``, and the near word ``best`` of largest ``best_n`` of every word that has near ones."""
    filed = _split(_filed(words), large)
    dealt = filed.repartition("L", "s", "t", "key").sortWithinPartitions("L", "s", "t", "key", F.desc("n"), "word")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best")))
    out = dealt.mapInArrow(_near_in_keys, NEAR).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b"))
    return out.select("word", "n_near", (-F.col("_b.m")).alias("best_n"), F.col("_b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the last of the forms ``(word, form)`` from each word on. Each round doubles the steps; forms never lead back, as counts grow."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        moved = now.join(further, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("more"))
        moved = materialize(moved, "spelling-roots")
        now = moved.select("word", "root")
        if moved.where("more").isEmpty():
            return now


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = 5, least: int = 3, noise: int = 97, ratio: int = 2, large: int = LARGE) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of every word.

    A word's form is its near word of largest count, if that is at least ``ratio`` times its own; its root is the last of the forms from it on.
    """
    words = materialize(word_counts(docs, doc_id, text, least_chars, least, noise), "spelling-words")
    near = words.join(near_words(words, large), "word", "left")
    isform = F.col("best_n") >= ratio * F.col("n")
    known = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(isform, F.col("best")).alias("form"), F.when(isform, F.col("best_n")).alias("form_n"))
    known = materialize(known, "spelling-forms")
    last = roots(known.where("form IS NOT NULL")).withColumnRenamed("word", "_w")
    return known.join(last, F.col("word") == F.col("_w"), "left").withColumn("root", F.coalesce("root", "word")).drop("_w")
