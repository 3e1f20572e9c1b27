"""Spelling variants: words one edit apart, grouped under the most frequent form.

If two words differ by one inserted, deleted or replaced code point, the edit lies in one half of the first word; its other half
stands unchanged in the second, the first half at its start or the second half at its end. So the halves of all words
are held by Aho-Corasick automata, and all words are scanned: a hit counts if it lies at the start (or end), if the lengths are
at most one apart, and if the rest differs by one edit. The words of a half may be many, so their rests aren't compared one by one: they are kept
under what one code point less leaves of them, where a rest one edit away is found.

The automata are shards. A hit at the start implies equal first code points (HEAD of them, as no half is shorter), one at the
end equal last ones (TAIL), so a half goes to the shard of its side and those code points, and a word is scanned in the shards of
its own. Code points that more than SHARD words share are split over several shards; their words are scanned in each of them. So no
automaton outgrows a bound whatever the vocabulary is. Words are counted in tasks before they are shuffled.

Defined results: a null text has no words; a null identifier counts as empty text in the checksum; rows that repeat identifier and text count
as often as they stand there; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgate.llm.common import bounded_broadcast, materialise

LEAST_LENGTH, LEAST_COUNT, RATIO, SLIP = 7, 2, 10, 31
#: Code points that the two halves of a word of LEAST_LENGTH have at least.
HEAD, TAIL = LEAST_LENGTH // 2, LEAST_LENGTH - LEAST_LENGTH // 2
#: Words whose halves an automaton holds; different words that a task counts before it hands them on; characters above which a text's
#: words aren't listed at once; code points of a rest up to which its cuts are kept.
SHARD, COUNTED, LONG, LONG_REST = 4_000, 200_000, 1 << 22, 64

#: Runs of at least LEAST_LENGTH letters, in a text whose A-Z are lower-cased: shorter ones aren't matched, longer ones from their start.
_long_runs = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")


def _batch(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.values(), strict=True)], names=list(schema))


def slipped(doc_id: str, run: str) -> str:
    """The run as counted: without one code point where SLIP divides the checksum of identifier and run."""
    h = zlib.crc32(run.encode(), zlib.crc32(f"{doc_id}:".encode()))
    return run[: h % len(run)] + run[h % len(run) + 1 :] if h % SLIP == 0 else run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(identifier, text as bytes) -> (word, n)."""
    schema = {"word": pa.string(), "n": pa.int64()}
    total: Counter[str] = Counter()
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            lowered = (text.as_py() or b"").lower().decode("utf-8", "replace")  # of bytes: A-Z only
            own = Counter(_long_runs.findall(lowered) if len(lowered) < LONG else map(re.Match.group, _long_runs.finditer(lowered)))
            for run, n in own.items():
                word = slipped(doc_id or "", run)
                if len(word) >= LEAST_LENGTH:
                    total[word] += n
            if len(total) > COUNTED:
                yield _batch(schema, list(total.items()))
                total.clear()
    if total:
        yield _batch(schema, list(total.items()))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of the words that occur LEAST_COUNT times at least."""
    slim = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    found = slim.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= LEAST_COUNT)


def cuts(text: str) -> list[str]:
    """What is left of a text without each of its code points."""
    return [text[:i] + text[i + 1 :] for i in range(len(text))]


def differ_by_one(a: str, b: str) -> bool:
    if len(a) < len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a[i + 1 :] == b[i:] if len(a) == len(b) + 1 else len(a) == len(b) and i < len(a) and a[i + 1 :] == b[i + 1 :]


class _Rests:
    """Words with a common half, by what else they have. Of rests above LONG_REST code points the cuts would take too much; those are compared."""

    def __init__(self, size: int):
        self.size = size  # of the half
        self.whole: dict[str, tuple[str, int]] = {}
        self.cut: dict[str, list[tuple[int, str, int]]] = defaultdict(list)
        self.long: list[tuple[str, str, int]] = []

    def add(self, rest: str, word: str, n: int) -> None:
        if len(rest) > LONG_REST:
            self.long.append((rest, word, n))
            return
        self.whole[rest] = (word, n)
        for i, left in enumerate(cuts(rest)):
            self.cut[left].append((i, word, n))

    def one_edit(self, rest: str, word: str) -> dict[str, int]:
        """The words (and their counts) whose rest is one edit away; word: the one that rest belongs to."""
        found = {other: n for _, other, n in self.cut.get(rest, ())}  # one code point more
        if len(rest) >= LONG_REST:
            found |= {other: n for its, other, n in self.long if abs(len(its) - len(rest)) <= 1 and differ_by_one(its, rest)}
        if len(rest) <= LONG_REST + 1:
            for i, left in enumerate(cuts(rest)):
                if left in self.whole:
                    found.update([self.whole[left]])
                found |= {other: n for j, other, n in self.cut.get(left, ()) if i == j and other != word}
        return found


def _shard(side: int, words: list[tuple[str, int]]) -> ahocorasick.Automaton:
    """First halves of the words at side 0, second halves at side 1, each with its _Rests."""
    held: dict[str, _Rests] = {}
    for word, n in words:
        middle = len(word) // 2
        half, rest = (word[middle:], word[:middle]) if side else (word[:middle], word[middle:])
        held.setdefault(half, _Rests(len(half))).add(rest, word, n)
    automaton = ahocorasick.Automaton()
    for half, rests in held.items():
        automaton.add_word(half, rests)
    automaton.make_automaton()
    return automaton


def near(automaton: ahocorasick.Automaton, side: int, word: str) -> list[tuple[str, int]]:
    """The held words (and their counts) near word that this side has to find; a pair that both halves find is left to side 0."""
    found: dict[str, int] = {}
    for end, rests in automaton.iter(word):
        if side and end == len(word) - 1:
            found |= {w: n for w, n in rests.one_edit(word[: -rests.size], word).items() if not word.startswith(w[: len(w) // 2])}
        elif not side and end == rests.size - 1:
            found |= rests.one_edit(word[rests.size :], word)
    return list(found.items())


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(side, shard, scanned, word, n), a shard's halves before the words to scan -> (word, n_near, form_n, form)."""
    schema = {"word": pa.string(), "n_near": pa.int64(), "form_n": pa.int64(), "form": pa.string()}
    at, words, automaton = None, [], None
    for b in batches:
        out = []
        for side, shard, scanned, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (side, shard) != at:
                at, words, automaton = (side, shard), [], None
            if not scanned:
                words.append((word, n))
                continue
            if words:
                automaton, words = _shard(side, words), []
            found = near(automaton, side, word) if automaton is not None else []
            if found:
                form, form_n = min(found, key=lambda x: (-x[1], x[0]))
                out.append((word, len(found), form_n, form))
        if out:
            yield _batch(schema, out)


def near_words(words: DataFrame) -> DataFrame:
    """words (word, n), materialised -> word, n_near, form, form_n: how many words are near, and the most frequent of them; words without any are left out."""
    shards = max(1, -(-words.count() // SHARD))
    sided = words.select("*", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.substring("word", 1, HEAD).alias("part")), F.struct(F.lit(1).alias("side"), F.substring("word", -TAIL, TAIL).alias("part")))).alias("at"))
    sided = sided.select("word", "n", "at.side", "at.part")
    split = materialise(sided.groupBy("side", "part").count().where(F.col("count") > SHARD).select("side", "part", F.ceil(F.col("count") / SHARD).alias("more")), "shared")  # a row for SHARD words at least
    dealt = sided.join(bounded_broadcast(split), ["side", "part"], "left").withColumns({"more": F.coalesce("more", F.lit(1)), "h": F.xxhash64("part")})
    held = dealt.select("side", F.pmod(F.col("h") + F.pmod(F.xxhash64("word"), "more"), F.lit(shards)).alias("shard"), F.lit(0).alias("scanned"), "word", "n")
    each = dealt.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("more") - 1)))
    scanned = each.select("side", F.pmod(F.col("h") + F.col("j"), F.lit(shards)).alias("shard"), F.lit(1).alias("scanned"), "word", "n")
    ordered = held.unionByName(scanned).repartition("side", "shard").sortWithinPartitions("side", "shard", "scanned")
    found = ordered.mapInArrow(_scan, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("down"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.form", (-F.col("best.down")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, root), each word once -> (word, root) with roots followed to the last, by pointer doubling.

    Counts grow along a chain, so there is no circle, and few rounds are needed."""
    state = materialise(forms, "forms")
    while True:
        above = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state = materialise(state.select("word", "root").join(above, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if state.where("moved").isEmpty():
            return state.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = materialise(word_counts(docs, id_col, text_col), "words")
    frequent = F.col("form_n") >= RATIO * F.col("n")
    wide = words.join(near_words(words), "word", "left")
    wide = materialise(wide.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(frequent, F.col("form")).alias("form"), F.when(frequent, F.col("form_n")).alias("form_n")), "near")
    found = roots(wide.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return wide.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
