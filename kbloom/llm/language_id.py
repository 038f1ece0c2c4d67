"""Language spans: script candidates, per-word scores and Viterbi decoding.

Training counts hashed character bigrams and trigrams, and words of each
script, per language over all labelled documents; the table's size depends on
the number of languages alone, and it is broadcast in blocks of languages of
which a worker holds one at a time.  A word's candidates are the languages that use
its script; its score for each is the log-likelihood of its n-grams.  Viterbi
over the words of a document, with a penalty for every switch, labels spans of
mixed-language text.  A document's language is the one with most letters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kbloom.llm import _text
from kbloom.llm._io import Shared, shielded, table

BUCKETS = 1 << 15
SWITCH_PENALTY = 8.0
#: A language uses a script if so large a share of its words is in it.
SCRIPT_SHARE = 0.001
#: A word's score, against its likeliest language, in one that doesn't use its script.
NOT_A_CANDIDATE = -60.0
#: Languages of one block of the model; a block takes 32 MB.
BLOCK_LANGUAGES = 256
#: Text decoded in one run of Viterbi steps, for up to eight languages; less for more.
GROUP_BYTES = 8 << 20

# First code points of Unicode script ranges, in order; what lies
# between a range's end and the next start counts as script 0.
SCRIPTS = [
    (0x0041, 0x024F), (0x0370, 0x03FF), (0x0400, 0x052F), (0x0530, 0x058F), (0x0590, 0x05FF), (0x0600, 0x077F),
    (0x0900, 0x097F), (0x0980, 0x09FF), (0x0A00, 0x0A7F), (0x0A80, 0x0AFF), (0x0B80, 0x0BFF), (0x0C00, 0x0C7F),
    (0x0C80, 0x0CFF), (0x0D00, 0x0D7F), (0x0E00, 0x0E7F), (0x1000, 0x109F), (0x10A0, 0x10FF), (0x1100, 0x11FF),
    (0x1200, 0x137F), (0x1780, 0x17FF), (0x1E00, 0x1EFF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF),
]

_POINTS: tuple | None = None


def _points():
    """Per code point: is it a letter, its lower case, its script."""
    global _POINTS
    if _POINTS is None:
        every = [chr(i) for i in range(0x110000)]
        letter = np.fromiter((c.isalpha() for c in every), bool, len(every))
        lower = np.arange(len(every), dtype=np.uint32)
        for i in np.flatnonzero(letter).tolist():
            x = every[i].lower()
            if len(x) == 1:
                lower[i] = ord(x)
        script = np.zeros(len(every), np.uint8)
        for k, (lo, hi) in enumerate(SCRIPTS, 1):
            script[lo : hi + 1] = k
        script[0x1E00:0x1F00] = 1
        _POINTS = letter, lower, script
    return _POINTS


def _words(data: np.ndarray, offsets: np.ndarray):
    """Letter runs of a chunk: bounds in code points, first word of each row."""
    letter, lower, script = _points()
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    upto = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    at = upto[offsets]
    flag = letter[chars]
    if len(chars) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64), chars, none, at
    full = at[:-1] < at[1:]
    before = np.concatenate([[False], flag[:-1]])
    before[at[:-1][full]] = False
    after = np.concatenate([flag[1:], [False]])
    after[at[1:][full] - 1] = False
    starts, ends = np.flatnonzero(flag & ~before), np.flatnonzero(flag & ~after) + 1
    return starts, ends, np.searchsorted(starts, at), lower[chars], script[chars[starts]], at


def _grams(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Hash buckets of each word's padded bigrams and trigrams, word by word.

    Each letter gives the bigram and the trigram that end at it; one further
    bigram ends at the word's end.  Returns (buckets, word numbers).
    """
    n = ends - starts
    own = np.repeat(np.arange(len(n)), n + 1)
    i = starts[own] + np.arange(len(own)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
    held = np.concatenate([chars, np.zeros(1, np.uint32)]).astype(np.uint64)
    third = np.where(i < ends[own], held[i], 0)
    second = np.where(i - 1 >= starts[own], held[i - 1], 0)
    first = np.where(i - 2 >= starts[own], held[i - 2], 0)
    two = _text.mix(second * np.uint64(0x200003) + third + np.uint64(1 << 60))
    three = _text.mix((first * np.uint64(0x200003) + second) * np.uint64(0x200003) + third)
    mask = np.uint64(BUCKETS - 1)
    return (two & mask).astype(np.int64), (three & mask).astype(np.int64), own


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: n-gram and script counts of each language."""
    held: dict[str, np.ndarray] = {}
    size = BUCKETS + len(SCRIPTS) + 1
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lo, hi, data, offsets in _text.chunks(batch.column(1)):
            starts, ends, first, chars, script, _ = _words(data, offsets)
            if len(starts) == 0:
                continue
            two, three, own = _grams(chars, starts, ends)
            names = sorted(set(langs[lo:hi]))
            code = np.array([names.index(x) for x in langs[lo:hi]])
            word = np.repeat(code, np.diff(first)) * size
            sums = np.bincount(np.concatenate([word[own] + two, word[own] + three, word + BUCKETS + script]), minlength=size * len(names))
            for k, name in enumerate(names):
                held[name] = held.get(name, 0) + sums[k * size : (k + 1) * size]
    for name, sums in held.items():
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(sums[at])], ["lang", "bucket", "n"])


class Block:
    """Log-likelihoods [bucket, language] and script use [script, language] of some languages."""

    def __init__(self, sums: np.ndarray):
        grams, scripts = sums[:BUCKETS], sums[BUCKETS:]
        self.table = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS)).astype(np.float32)
        share = scripts / np.maximum(1, scripts.sum(0))
        self.uses = share >= SCRIPT_SHARE


class Model:
    """Languages in order of name, and their blocks, packed and broadcast."""

    def __init__(self, langs: list[str], blocks: list[Shared]):
        self.langs, self.blocks = langs, blocks

    def tables(self) -> Iterator[Block]:
        """Each block in turn; unpacked anew if there are several."""
        for block in self.blocks:
            yield block.once(_unpacked)


def _packed(sums: list[np.ndarray]) -> bytes:
    return zlib.compress(np.stack(sums, 1).astype(np.float32).tobytes(), 1)


def _unpacked(data: bytes) -> Block:
    return Block(np.frombuffer(zlib.decompress(data), np.float32).reshape(BUCKETS + len(SCRIPTS) + 1, -1).astype(np.float64))


def train(labelled: DataFrame, block_languages: int = BLOCK_LANGUAGES) -> Model:
    """A model from ``labelled(text, lang)``; rows with a null in either are skipped."""
    rows = labelled.where("lang is not null and text is not null").select("lang", "text")
    sums = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    size = BUCKETS + len(SCRIPTS) + 1
    # one row for each language, in order of name; the driver holds one block of them
    each = sums.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("ns")).orderBy("lang")
    langs, blocks, held = [], [], []
    for lang, buckets, ns in each.toLocalIterator():
        if len(held) == block_languages:
            blocks.append(Shared(labelled.sparkSession, _packed(held)))
            held = []
        langs.append(lang)
        held.append(np.bincount(buckets, weights=ns, minlength=size))
    if held:
        blocks.append(Shared(labelled.sparkSession, _packed(held)))
    return Model(langs, blocks)


def _scores(model: Model, chars, starts, ends, script) -> np.ndarray:
    """[word, language]: log-likelihood, or NOT_A_CANDIDATE by script."""
    out = np.zeros((len(starts), len(model.langs)), np.float32)
    if len(starts) == 0:
        return out
    two, three, own = _grams(chars, starts, ends)
    begin = np.searchsorted(own, np.arange(len(starts)))
    uses, at = np.zeros(out.shape, bool), 0
    for block in model.tables():
        to = at + block.table.shape[1]
        out[:, at:to] = np.add.reduceat(block.table[two] + block.table[three], begin, axis=0)
        uses[:, at:to] = block.uses[script]
        at = to
    narrowed = uses.any(1)
    out[~narrowed] = 0
    others = narrowed[:, None] & ~uses
    out[others] = -np.inf
    # only differences between the languages matter
    out -= out.max(1, keepdims=True, initial=-np.inf)
    out[others] = NOT_A_CANDIDATE
    return out


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word; rows first[i]:first[i+1] are a document.

    All documents advance together, longest first, so a step is a few array
    operations over those that still have words.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    n, begin = n[order], first[:-1][order]
    kind = np.int8 if scores.shape[1] <= 127 else np.int16 if scores.shape[1] < 1 << 15 else np.int32
    path = np.zeros(len(scores), kind)
    if len(scores) == 0:
        return path
    active = np.searchsorted(-n, -np.arange(1, n[0] + 1), "right")
    states = np.arange(scores.shape[1], dtype=kind)
    value = scores[begin[: active[0]]].copy()
    last = np.zeros(len(n), kind)
    back = [None] * int(n[0])
    for t in range(1, int(n[0])):
        k = int(active[t])
        if k < len(value):
            last[k : len(value)] = value[k:].argmax(1)
            value = value[:k]
        best = value.argmax(1)
        jump = value[np.arange(k), best] - penalty
        back[t] = np.where(value < jump[:, None], best[:, None].astype(kind), states)
        value = np.maximum(value, jump[:, None]) + scores[begin[:k] + t]
    last[: len(value)] = value.argmax(1)
    for t in range(int(n[0]) - 1, -1, -1):
        k = int(active[t])
        path[begin[:k] + t] = last[:k]
        if t:
            last[:k] = back[t][np.arange(k), last[:k]]
    return path


def _decode(model: Model, data: np.ndarray, offsets: np.ndarray, penalty: float):
    """Words of a group of rows (starts, ends, first, path) in code points."""
    starts, ends, first, scores, at = [], [], [0], [], [0]
    lo = 0
    while lo < len(offsets) - 1:
        hi = min(max(int(np.searchsorted(offsets, offsets[lo] + _text.CHUNK_BYTES, "right")) - 1, lo + 1), len(offsets) - 1)
        s, e, f, chars, script, a = _words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        scores.append(_scores(model, chars, s, e, script))
        starts.append(s + at[-1])
        ends.append(e + at[-1])
        first.extend((f[1:] + first[-1]).tolist())
        at.extend((a[1:] + at[-1]).tolist())
        lo = hi
    first = np.array(first)
    path = viterbi(np.concatenate(scores), first, penalty)
    return np.concatenate(starts), np.concatenate(ends), first, path, np.array(at)


def _label(shared: Model, penalty: float, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared
        names = np.array([*model.langs, "und"], object)
        wide = len(model.langs)
        for batch in batches:
            for lo, hi, data, offsets in _text.chunks(batch.column(0), GROUP_BYTES * 8 // max(8, wide)):
                if wide == 0:
                    pred, share, runs = np.zeros(hi - lo, np.int64), np.zeros(hi - lo), [[] for _ in range(hi - lo)]
                else:
                    starts, ends, first, path, at = _decode(model, data, offsets, penalty)
                    row = np.repeat(np.arange(hi - lo), np.diff(first))
                    sums = np.bincount(row * wide + path, weights=ends - starts, minlength=(hi - lo) * wide).reshape(-1, wide)
                    total = sums.sum(1)
                    pred = np.where(total > 0, sums.argmax(1), wide)
                    share = np.where(total > 0, sums.max(1) / np.maximum(total, 1), 0.0)
                    if spans:
                        new = np.ones(len(path), bool)
                        new[1:] = (path[1:] != path[:-1]) | (row[1:] != row[:-1])
                        i = np.flatnonzero(new)
                        j = np.append(i[1:], len(path))[: len(i)] - 1
                        runs = [[] for _ in range(hi - lo)]
                        for r, s, e, k in zip(row[i].tolist(), (starts[i] - at[row[i]]).tolist(), (ends[j] - at[row[i]]).tolist(), path[i].tolist(), strict=True):
                            runs[r].append({"start": s, "stop": e, "lang": model.langs[k]})
                part = batch.slice(lo, hi - lo)
                made = [pa.array(names[pred].tolist(), pa.string()), pa.array(share)]
                if spans:
                    made.append(pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays([*made, *part.columns[1:]], ["lang_pred", "score", *["lang_spans"] * spans, *part.schema.names[1:]])

    return run


def predict(spark: SparkSession, docs: DataFrame, model: Model, others: list[str], penalty: float = SWITCH_PENALTY, spans: bool = True) -> DataFrame:
    """lang_pred, score, lang_spans and the columns ``others`` of each row.

    The score is the share of the letters in spans of the predicted language.
    A null text, one without a letter, or a model without languages gives
    ``und``, 0 and no spans.  Spans are in code points, from the first letter of
    their first word to past the last of their last.  A column of ``others`` that
    has one of these names is ``_kept_<name>``.
    """
    made = "lang_pred string, score double" + ", lang_spans array<struct<start: int, stop: int, lang: string>>" * spans
    docs, old = shielded(docs.select("text", *others), "lang_pred", "score", *["lang_spans"] * spans)
    now = {v: k for k, v in old.items()}
    others = [now.get(c, c) for c in others]
    schema = StructType([*StructType.fromDDL(made).fields, *(docs.schema[c] for c in others)])
    return docs.select("text", *others).mapInArrow(_label(model, penalty, spans), schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: held_out, the predicted language and its share of letters.

    A null text, or one without a letter, is ``und`` with score 0; languages of
    equal letters go to the first by name.  Repeated rows are judged each.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    out = predict(spark, docs.select("text", "doc_id"), model, ["doc_id"], spans=False)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
