"""Language-model scores of whole documents: word frequencies of the corpus, and a causal attention model.

The word counts cover every training document.  They travel by the exchange of ``exchange.py``: a bucket of
documents sends its distinct words' hashes with counts to shards and gets the corpus counts back, so a word
costs a few bytes per bucket and no vocabulary is ever in one place.

The attention model reads subword ids: a truncated public byte-level vocabulary, whose merges are a valid
vocabulary of their own.  Its weights start from gradient steps on a uniform sample of the training documents
of about ``sample_bytes`` bytes.  From there every bucket learns from all its training documents, and the mean
of the buckets' weights, each counted by its subwords, is the model: its work follows the corpus.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm import attention_lm as A
from sightline.llm import exchange as X
from sightline.llm.bpe import BYTE_BASE, _Ragged, build_model
from sightline.llm.textarrays import Words, hash_words, split_words
from sightline.session import materialise

SAMPLE_BYTES = 3_000_000
STEPS = 2400
#: Share of the corpus counts in the probability of a word; measured as best on held-out documents between 0.5 and 0.8.
COUNT_SHARE = 0.65
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_COUNTS = "shard long, __bucket int, hashes binary, counts binary"
_LEARNED = "part int, __bucket int, subwords double, weights binary"
#: Groups in which the buckets' weights are added up, so that the driver gets so many sums at most.
PARTS = 32
_TOTALS = "shard long, __bucket int, counts binary, types long, tokens long"


class Lexicon:
    """Distinct words of a batch of texts, ASCII-lowered: sorted hashes, and where each word of the batch is."""

    def __init__(self, column: pa.ChunkedArray | pa.Array):
        words = split_words(column)
        self.words = Words(_LOWER[words.data], words.first, words.starts, words.ends)
        self.hashes, self.example, self.place = np.unique(hash_words(self.words, 3), return_index=True, return_inverse=True)
        self.sizes = np.zeros(len(self.hashes), np.int64)  # subwords of each word, once they are encoded

    def spellings(self) -> list[bytes]:
        data, starts, ends = self.words.data.tobytes(), self.words.starts[self.example].tolist(), self.words.ends[self.example].tolist()
        return [data[a:b] for a, b in zip(starts, ends)]


class Subwords:
    """Encodes words, each with a space before it, by the lowest ranks of a byte-level vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=build_model(tokens[: A.END]))

    def encode(self, words: list[bytes]) -> _Ragged:
        raw = b" " + b" ".join(words) if words else b""
        mapped = (np.frombuffer(raw, np.uint8) + np.uint16(BYTE_BASE)).astype("<u2").tobytes().decode("utf-16-le")
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        found = self.processor.encode([mapped[a:b] for a, b in zip([0, *ends], ends)], num_threads=1)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return _Ragged(np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum())), sizes)

    def streams(self, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each text closed by END, and where each text begins."""
        pieces = self.encode(lexicon.spellings())
        lexicon.sizes = pieces.sizes
        inner = pieces.take(lexicon.place)
        ends = np.concatenate([[0], np.cumsum(pieces.sizes[lexicon.place])])[lexicon.words.first[1:]]
        ids = np.insert(inner, ends, A.END)
        return ids, np.concatenate([[0], ends + 1 + np.arange(len(ends))])


def class_of_subwords(tokens: list[bytes]) -> np.ndarray:
    """Neighbours in byte order share a class; the end of a text comes last."""
    order = sorted(range(A.END), key=lambda i: tokens[i]) + [A.END]
    out = np.empty(A.VOCABULARY, np.int64)
    out[order] = np.arange(A.VOCABULARY) // A.MEMBERS
    return out


def fit_model(training: DataFrame, tokens: list[bytes], total_bytes: int, sample_bytes: int = SAMPLE_BYTES, steps: int = STEPS) -> A.Weights:
    """Weights fitted on a uniform sample of the texts in ``training`` (id, text), in one task.

    The sample holds about ``sample_bytes`` bytes; a single text beyond four times that is cut off there.
    """
    share = min(1.0, sample_bytes / max(1, total_bytes))
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit("sample")), F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30)))
    sample = training.where(draw).select("id", "text").repartition(1).sortWithinPartitions("id", "text").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, parts, firsts, size = Subwords(tokens), [], [np.zeros(1, np.int64)], 0
        for batch in batches:
            ids, first = subwords.streams(Lexicon(batch.column(0)))
            parts.append(ids)
            firsts.append(first[1:] + size)
            size += len(ids)
            if size > 4 * sample_bytes:
                break
        ids = np.concatenate([np.zeros(0, np.int64), *parts])
        classes = class_of_subwords(tokens)
        weights = A.initial(classes, np.bincount(ids, minlength=A.VOCABULARY))
        weights = A.train(weights, classes, A.windows(ids, np.concatenate(firsts)), steps)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(weights)], pa.binary())], names=["weights"])

    found = sample.mapInArrow(run, "weights binary").collect()
    if found:
        return pickle.loads(found[0].weights)
    return A.initial(class_of_subwords(tokens), np.zeros(A.VOCABULARY))


def learn_from_all(dealt: DataFrame, tokens: list[bytes], start: A.Weights) -> A.Weights:
    """The mean of the weights that the buckets of ``dealt`` reach from ``start``, each by a pass over its training texts."""
    shared = dealt.sparkSession.sparkContext.broadcast((tokens[: A.END], start))

    def learn(table: pa.Table) -> pa.Table:
        vocabulary, w = shared.value
        ordered = table.sort_by([("id", "ascending"), ("text", "ascending")])
        ids, first = Subwords(vocabulary).streams(Lexicon(ordered["text"]))
        w = A.train_stream(w, class_of_subwords(vocabulary), ids, first)
        bucket = table[X.BUCKET][0].as_py()
        blob = pickle.dumps({k: v.astype(np.float64) * len(ids) for k, v in w.items()})
        return pa.table([pa.array([x], t) for x, t in ((bucket % PARTS, pa.int32()), (bucket, pa.int32()), (float(len(ids)), pa.float64()), (blob, pa.binary()))], names=["part", X.BUCKET, "subwords", "weights"])

    def add_up(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in tables:
            for part, _, n, blob in zip(*(c.to_pylist() for c in batch.columns)):
                held, w = sums.get(part), pickle.loads(blob)
                sums[part] = [n, w] if held is None else [held[0] + n, {k: held[1][k] + v for k, v in w.items()}]
        for part, (n, w) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([part], pa.int32()), pa.array([n], pa.float64()), pa.array([pickle.dumps(w)], pa.binary())], names=["part", X.BUCKET, "subwords", "weights"])

    learned = dealt.where("train").groupBy(X.BUCKET).applyInArrow(learn, _LEARNED)
    parts = learned.repartition(PARTS, "part").sortWithinPartitions("part", X.BUCKET).mapInArrow(add_up, _LEARNED).collect()
    total = sum(r.subwords for r in parts)
    if not total:
        return start
    sums = [pickle.loads(r.weights) for r in sorted(parts, key=lambda r: r.part)]
    return {k: (sum(w[k] for w in sums) / total).astype(np.float32) for k in start}


def score_documents(
    docs: DataFrame, is_training: Column, tokens: list[bytes], id_column: str = "doc_id", text_column: str = "text",
    sample_bytes: int = SAMPLE_BYTES, steps: int = STEPS, bucket_bytes: int = X.BUCKET_BYTES, count_share: float = 0.0,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Tokens are ASCII-lowered words and one end.  ``base_score`` is the sum of log10((c + 0.5) / (N + 0.5 (V + 1)))
    with the counts of the training rows; ``score`` the model's log10 probability of the words with single
    spaces, and the end.  With ``count_share`` the probability of each word, and of the end, is that share of its
    frequency in the corpus and the rest of the attention model's: the counts know the words, the model their
    context and the spelling of new ones.  Null texts are empty.  Rows for which ``is_training`` is null are held out.
    Repeated rows count repeatedly; other columns are ignored.  Without ``steps`` the model stays untrained.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"), F.coalesce(is_training, F.lit(False)).alias("train"))
    dealt, total = X.deal(rows, "id", "text", bucket_bytes)
    shards = max(1, math.ceil(total / (32 << 20)))
    shard_width = min(2**64 // shards + 1, 2**64 - 1)
    ends = rows.where("train").count()

    def count(table: pa.Table) -> pa.Table:
        lexicon, bucket = Lexicon(table["text"]), table[X.BUCKET][0].as_py()
        trained = table["train"].to_numpy()[lexicon.words.text_of_word]
        counts = np.bincount(lexicon.place, trained, len(lexicon.hashes)).astype(np.uint64)
        slices = X.shard_slices(lexicon.hashes, shard_width)
        return pa.table({
            "shard": pa.array([s for s, _, _ in slices], pa.int64()), X.BUCKET: pa.array([bucket] * len(slices), pa.int32()),
            "hashes": pa.array([X.pack_sorted(lexicon.hashes[a:b]) for _, a, b in slices], pa.binary()),
            "counts": pa.array([X.pack(counts[a:b]) for _, a, b in slices], pa.binary()),
        })

    def add_up(table: pa.Table) -> pa.Table:
        hashes, counts = ([f(b) for b in table[c].to_pylist()] for c, f in (("hashes", X.unpack_sorted), ("counts", X.unpack)))
        _, place = np.unique(np.concatenate(hashes), return_inverse=True)
        sums = np.bincount(place, np.concatenate(counts).astype(np.float64))
        cuts = np.cumsum([len(h) for h in hashes])[:-1]
        back = [X.pack(s.astype(np.uint64)) for s in np.split(sums[place], cuts)]
        n = len(back)
        return pa.table({
            "shard": pa.array([table["shard"][0].as_py()] * n, pa.int64()), X.BUCKET: table[X.BUCKET].cast(pa.int32()), "counts": pa.array(back, pa.binary()),
            "types": pa.array([int((sums > 0).sum())] + [0] * (n - 1), pa.int64()), "tokens": pa.array([int(sums.sum())] + [0] * (n - 1), pa.int64()),
        })

    summed = materialise(dealt.groupBy(X.BUCKET).applyInArrow(count, _COUNTS).groupBy("shard").applyInArrow(add_up, _TOTALS), "word_counts")
    types, words = summed.agg(F.sum("types"), F.sum("tokens")).first()
    train_tokens = (words or 0) + ends
    base = train_tokens + 0.5 * ((types or 0) + (ends > 0) + 1)
    weights = fit_model(rows.where("train"), tokens, total, sample_bytes, steps)
    if steps:
        weights = learn_from_all(dealt, tokens, weights)
    model = docs.sparkSession.sparkContext.broadcast((tokens[: A.END], weights))
    kind = docs.schema[id_column].dataType.simpleString()
    arrow_ids = f"`{id_column}` {kind}"
    out = f"{arrow_ids}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def total(logs: np.ndarray, first: np.ndarray, lexicon: Lexicon, counts: np.ndarray) -> np.ndarray:
        """Natural log-probability of each text from those of its ids and the counts of its words."""
        texts = len(first) - 1
        if not count_share:
            return np.bincount(np.repeat(np.arange(texts), np.diff(first)), logs, texts)
        spelt, text = lexicon.sizes[lexicon.place], lexicon.words.text_of_word
        # ids of a text are those of its words, then its end: an end stands alone, like a word of one id
        starts = np.concatenate([np.cumsum(spelt) - spelt + text, first[1:] - 1])
        order = np.argsort(starts, kind="stable")
        model = np.empty(len(starts))
        model[order] = np.add.reduceat(logs, starts[order]) if texts else 0
        known = np.log(np.concatenate([counts[lexicon.place], np.full(texts, float(ends))]) + 0.5) - math.log(base)
        mixed = np.logaddexp(math.log(count_share) + known, math.log(1 - count_share) + model)
        return np.bincount(np.concatenate([text, np.arange(texts)]), mixed, texts)

    def score(table: pa.Table, back: pa.Table) -> pa.Table:
        vocabulary, w = model.value
        lexicon = Lexicon(table["text"])
        order = np.argsort(back["shard"].to_numpy()) if back.num_rows else []
        blobs = back["counts"].to_pylist() if back.num_rows else []
        counts = np.concatenate([np.zeros(0), *[X.unpack(blobs[i]).astype(np.float64) for i in order]])
        text, n = lexicon.words.text_of_word, table.num_rows
        logs = np.log10(counts + 0.5)[lexicon.place]
        n_tokens = np.diff(lexicon.words.first) + 1
        ids, first = Subwords(vocabulary).streams(lexicon)
        return pa.Table.from_arrays([
            table["id"], pa.array(~table["train"].to_numpy()), pa.array(n_tokens, pa.int64()),
            pa.array(np.bincount(text, counts[lexicon.place] > 0, n).astype(np.int64) + (ends > 0)), pa.array([train_tokens] * n, pa.int64()),
            pa.array(np.bincount(text, logs, n) + math.log10(ends + 0.5) - n_tokens * math.log10(base)),
            pa.array(total(A.token_scores(w, class_of_subwords(vocabulary), ids, first), first, lexicon, counts) / math.log(10)),
        ], names=[id_column, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return dealt.groupBy(X.BUCKET).cogroup(summed.groupBy(X.BUCKET)).applyInArrow(score, out)
