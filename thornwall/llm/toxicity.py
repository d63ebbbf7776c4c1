"""Toxicity by a small bidirectional gated recurrent network with attention, trained in numpy.

A word enters as the embedding of itself, if training saw it often enough, and the mean embedding of its character
n-grams. Texts are scored in overlapping windows of words; a text's score is that of its worst window. Training follows
suit: after a first look at windows from all over the labelled texts, each text teaches with its worst windows only,
which Spark's tasks find among all of its windows, round by round.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thornwall.llm.common import parts, some_of_each, text_bytes, written
from thornwall.llm.langid import in_fold

#: Words of a window and words from one window to the next.
WINDOW, STRIDE = 32, 16
#: Sizes: word and character embeddings, hidden units per direction, attention units, buckets of character n-grams.
WORD, CHAR, HIDDEN, LOOK, BUCKETS = 8, 12, 8, 8, 1 << 13
#: Shrinking of embeddings per step, in learning rates: words that say nothing are forgotten.
DECAY = 1.5
#: Bytes of a word at most, and bytes that the pieces of a longer run share at least: those of the longest n-gram.
PIECE, SHARED = 32, 5
#: Windows scored at once, and words that a worker remembers.
BATCH, MEMO = 1024, 100_000
#: Rows whose texts are held as bytes at once.
ROWS = 1024
#: Words of a very long text that are scored at once.
SECTION = STRIDE * BATCH

_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else 32 if b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128 else b for b in range(256)
)
#: White space beyond ASCII in UTF-8.
_SPACES = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def words_of(text: bytes) -> list[bytes]:
    """Words of a text: A-Z lower-cased, ASCII punctuation counts as white space, as does that of Unicode.

    Runs of more than ``PIECE`` bytes (scripts without spaces, long lines) become overlapping words of that size.
    """
    if not text.isascii():
        text = _SPACES.sub(b" ", text)
    found = text.translate(_FOLD).split()
    if max(map(len, found), default=0) <= PIECE:
        return found
    return [piece for word in found for piece in (_pieces(word) if len(word) > PIECE else (word,))]


def _pieces(word: bytes) -> Iterator[bytes]:
    """Overlapping pieces that begin and end between characters; each n-gram of the word is whole in one of them."""

    def border(at: int) -> int:
        for back in range(4):
            if word[at - back] & 0xC0 != 0x80:
                return at - back
        return at  # not UTF-8

    start = 0
    while len(word) - start > PIECE:
        stop = border(start + PIECE)
        yield word[start:stop]
        start = border(stop - SHARED)
    yield word[start:]


def char_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word index) of the 3-, 4- and 5-byte n-grams of each word between edge marks, in word order."""
    joined = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(joined))  # bytes from here to the end of the word
    buckets, owners = [], []
    for size in (3, 4, 5):
        many = len(joined) - size + 1
        if many < 1:
            continue
        mixed = np.full(many, size, np.uint64)
        for k in range(size):
            mixed = (mixed ^ joined[k : k + many]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(31)
        fits = left[:many] >= size
        buckets.append((mixed[fits] % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[:many][fits])
    buckets, owners = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return buckets[order], owners[order]


def windows_of(many: int) -> list[tuple[int, int]]:
    """The overlapping windows over so many words; the last one ends with the text."""
    starts = range(0, max(1, many - STRIDE), STRIDE)
    return [(s, min(many, s + WINDOW)) for s in starts] if many else []


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Vocabulary and weights. ``forward`` keeps what ``backward`` needs."""

    vocabulary: dict[bytes, int]
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, vocabulary: dict[bytes, int], seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)

        def draw(*shape: int) -> np.ndarray:
            return (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)

        size = WORD + CHAR
        weights = {"words": np.zeros((len(vocabulary) + 1, WORD), np.float32), "chars": np.zeros((BUCKETS, CHAR), np.float32)}
        for way in "fb":  # forward and backward: input, recurrent and bias of update, reset and candidate
            weights |= {f"in_{way}": draw(size, 3 * HIDDEN), f"re_{way}": draw(HIDDEN, 3 * HIDDEN), f"bias_{way}": np.zeros(3 * HIDDEN, np.float32)}
        weights |= {"look": draw(2 * HIDDEN, LOOK), "ask": draw(LOOK, 1)[:, 0], "out": draw(2 * HIDDEN, 1)[:, 0], "bias": np.zeros(1, np.float32)}
        return cls(vocabulary, weights)

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The input vector of each word, with its rows of both embeddings."""
        rows = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        buckets, owners = char_grams(words)
        many = np.bincount(owners, minlength=len(words)).astype(np.float32)
        sums = np.zeros((len(words), CHAR), np.float32)
        if len(owners):
            starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
            sums[owners[starts]] = np.add.reduceat(self.weights["chars"][buckets], starts, axis=0)
        chars = sums / np.sqrt(np.maximum(many, 1))[:, None]
        return np.concatenate([self.weights["words"][rows], chars], axis=1), rows, buckets, owners

    def _steps(self, gates: np.ndarray, mask: np.ndarray, way: str, keep: list | None) -> np.ndarray:
        """Hidden states [time, batch, HIDDEN] of one direction; padding leaves the state as it is."""
        recurrent = self.weights[f"re_{way}"]
        times = range(len(gates)) if way == "f" else range(len(gates) - 1, -1, -1)
        state = np.zeros((gates.shape[1], HIDDEN), np.float32)
        out = np.empty((*gates.shape[:2], HIDDEN), np.float32)
        for t in times:
            pre = state @ recurrent[:, : 2 * HIDDEN]
            pre += gates[t, :, : 2 * HIDDEN]
            both = _sigmoid(pre)
            update, reset = both[:, :HIDDEN], both[:, HIDDEN:]
            gated = reset * state
            fresh = np.tanh(gates[t, :, 2 * HIDDEN :] + gated @ recurrent[:, 2 * HIDDEN :])
            new = state + mask[t][:, None] * update * (fresh - state)
            if keep is not None:
                keep.append((t, state, update, reset, fresh))
            state = out[t] = new
        return out

    def forward(self, gates: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Probability of each window. gates: [time, batch, 2 * 3 * HIDDEN], mask: [time, batch]."""
        w = self.weights
        steps: dict[str, list | None] = {way: ([] if keep is not None else None) for way in "fb"}
        states = [self._steps(gates[:, :, 3 * HIDDEN * n : 3 * HIDDEN * (n + 1)], mask, way, steps[way]) for n, way in enumerate("fb")]
        hidden = np.concatenate(states, axis=2)
        looked = np.tanh(hidden @ w["look"])
        scores = np.where(mask > 0, looked @ w["ask"], np.float32(-30))
        share = np.exp(scores - scores.max(0))
        share /= share.sum(0)
        context = (share[:, :, None] * hidden).sum(0)
        result = _sigmoid(context @ w["out"] + w["bias"])
        if keep is not None:
            keep |= {"steps": steps, "hidden": hidden, "looked": looked, "share": share, "context": context, "result": result, "mask": mask}
        return result

    def backward(self, keep: dict, target: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the mean log loss, and the gradient of the gates."""
        w = self.weights
        slope = ((keep["result"] - target) / len(target)).astype(np.float32)
        hidden, looked, share, mask = keep["hidden"], keep["looked"], keep["share"], keep["mask"]
        grads = {"out": keep["context"].T @ slope, "bias": slope.sum(keepdims=True)}
        d_context = slope[:, None] * w["out"]
        d_share = (hidden * d_context).sum(2)
        d_score = share * (d_share - (share * d_share).sum(0))
        d_look = d_score[:, :, None] * w["ask"] * (1 - looked**2)
        grads["ask"] = (looked * d_score[:, :, None]).sum((0, 1))
        grads["look"] = np.einsum("tbh,tbl->hl", hidden, d_look)
        d_hidden = share[:, :, None] * d_context + d_look @ w["look"].T
        d_gates = np.zeros((*mask.shape, 6 * HIDDEN), np.float32)
        for n, way in enumerate("fb"):
            recurrent = w[f"re_{way}"]
            d_recurrent = np.zeros_like(recurrent)
            flow = np.zeros((mask.shape[1], HIDDEN), np.float32)
            for t, state, update, reset, fresh in reversed(keep["steps"][way]):
                flow = flow + d_hidden[t, :, HIDDEN * n : HIDDEN * (n + 1)]
                moved = flow * mask[t][:, None]
                d_update = moved * (fresh - state) * update * (1 - update)
                d_fresh = moved * update * (1 - fresh**2)
                d_gated = d_fresh @ recurrent[:, 2 * HIDDEN :].T
                d_reset = d_gated * state * reset * (1 - reset)
                d_both = np.concatenate([d_update, d_reset], axis=1)
                d_recurrent[:, : 2 * HIDDEN] += state.T @ d_both
                d_recurrent[:, 2 * HIDDEN :] += (reset * state).T @ d_fresh
                d_gates[t, :, 3 * HIDDEN * n : 3 * HIDDEN * (n + 1)] = np.concatenate([d_both, d_fresh], axis=1)
                flow = flow - moved * update + d_gated * reset + d_both @ recurrent[:, : 2 * HIDDEN].T
            grads[f"re_{way}"] = d_recurrent
        return grads, d_gates

    def gates(self, vectors: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.concatenate([vectors @ w[f"in_{way}"] + w[f"bias_{way}"] for way in "fb"], axis=1)


class Trainer:
    """Adam over windows of indexed words."""

    def __init__(self, network: Network, rate: float = 0.01) -> None:
        self.network, self.rate, self.at = network, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in network.weights.items()}
        self.second = {k: np.zeros_like(v) for k, v in network.weights.items()}

    def step(self, words: list[bytes], rows: np.ndarray, mask: np.ndarray, target: np.ndarray) -> None:
        """rows: [batch, time] places in ``words``."""
        network, w = self.network, self.network.weights
        used, place = np.unique(rows, return_inverse=True)
        place = place.reshape(rows.shape)
        vectors, word_rows, buckets, owners = network.inputs([words[i] for i in used.tolist()])
        keep: dict = {}
        network.forward(network.gates(vectors)[place.T], mask.T, keep)
        grads, d_gates = network.backward(keep, target)
        flat = np.zeros((len(used), 6 * HIDDEN), np.float32)
        np.add.at(flat, place.T.ravel(), d_gates.reshape(-1, 6 * HIDDEN))
        d_vectors = np.zeros_like(vectors)
        for n, way in enumerate("fb"):
            part = flat[:, 3 * HIDDEN * n : 3 * HIDDEN * (n + 1)]
            grads[f"in_{way}"], grads[f"bias_{way}"] = vectors.T @ part, part.sum(0)
            d_vectors += part @ w[f"in_{way}"].T
        grads["words"], grads["chars"] = np.zeros_like(w["words"]), np.zeros_like(w["chars"])
        np.add.at(grads["words"], word_rows, d_vectors[:, :WORD])
        grads["words"][0] = 0  # unknown words have no embedding of their own
        scale = 1 / np.sqrt(np.maximum(np.bincount(owners, minlength=len(used)), 1))
        np.add.at(grads["chars"], buckets, (d_vectors[:, WORD:] * scale[:, None].astype(np.float32))[owners])
        self.at += 1
        for name, grad in grads.items():
            self.first[name] += 0.1 * (grad - self.first[name])
            self.second[name] += 0.001 * (grad**2 - self.second[name])
            step = self.first[name] / (1 - 0.9**self.at) / (np.sqrt(self.second[name] / (1 - 0.999**self.at)) + 1e-7)
            w[name] -= self.rate * step
            if name in ("words", "chars"):
                w[name] *= 1 - self.rate * DECAY


def _padded(spans: list[tuple[int, int]] | np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """([batch, WINDOW] codes, mask) of spans of ``codes``."""
    starts, stops = np.array(spans, np.int64).T
    places = starts[:, None] + np.arange(WINDOW)
    mask = places < stops[:, None]
    return codes[np.where(mask, places, starts[:, None])], mask.astype(np.float32)


class Scorer:
    """Scores texts; remembers the gates of words it has met."""

    def __init__(self, network: Network) -> None:
        self.network = network
        self.memo: dict[bytes, int] = {}
        self.table = np.zeros((0, 6 * HIDDEN), np.float32)

    def _codes(self, words: list[bytes]) -> np.ndarray:
        new = sorted(set(words).difference(self.memo))
        if len(self.memo) + len(new) > MEMO:
            self.memo, self.table = {}, self.table[:0]
            new = sorted(set(words))
        if new:
            first = len(self.memo)
            self.memo.update(zip(new, range(first, first + len(new)), strict=True))
            if len(self.memo) > len(self.table):  # room for twice as many, so that growing seldom copies
                grown = np.empty((2 * len(self.memo), 6 * HIDDEN), np.float32)
                grown[:first] = self.table[:first]
                self.table = grown
            for at in range(0, len(new), BATCH):
                own = new[at : at + BATCH]
                self.table[first + at : first + at + len(own)] = self.network.gates(self.network.inputs(own)[0])
        return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))

    def windows(self, words: list[bytes], spans: list[tuple[int, int]]) -> np.ndarray:
        codes = self._codes(words)
        out = []
        for at in range(0, len(spans), BATCH):
            rows, mask = _padded(spans[at : at + BATCH], codes)
            out.append(self.network.forward(self.table[rows.T], mask.T))
        return np.concatenate(out)

    def worst(self, texts: Iterable[bytes], many: Sequence[int]) -> list[list[tuple[float, bytes]]]:
        """(score, words) of the so many worst windows of each text, worst first; none for a text without words."""
        result: list[list[tuple[float, bytes]]] = []
        words: list[bytes] = []
        spans: list[tuple[int, int]] = []
        owners: list[int] = []

        def flush() -> None:
            nonlocal words, spans, owners
            if spans:
                values, owned = self.windows(words, spans), np.array(owners)
                starts = np.flatnonzero(np.r_[True, owned[1:] != owned[:-1]])
                for first, last in zip(starts.tolist(), [*starts[1:].tolist(), len(owned)], strict=True):
                    doc = owners[first]
                    top = first + np.argsort(-values[first:last], kind="stable")[: many[doc]]
                    found = [(float(values[n]), b" ".join(words[slice(*spans[n])])) for n in top.tolist()]
                    result[doc] = sorted(result[doc] + found, key=lambda x: -x[0])[: many[doc]]
            words, spans, owners = [], [], []

        for text in texts:
            result.append([])
            found = words_of(text)
            for at in range(0, len(found), SECTION):  # a very long text in sections of whole windows
                section = found[at : at + SECTION + WINDOW - STRIDE]
                own = windows_of(len(section))
                spans += [(len(words) + start, len(words) + stop) for start, stop in own]
                owners += [len(result) - 1] * len(own)
                words += section
                if len(spans) >= BATCH:
                    flush()
        flush()
        return result

    def scores(self, texts: Iterable[bytes]) -> list[float]:
        """The score of each text's worst window, 0 for a text without words."""
        texts = list(texts)
        return [found[0][0] if found else 0.0 for found in self.worst(texts, [1] * len(texts))]


#: (label, words joined by a space) of a window.
Window = tuple[int, bytes]


def _frequent_words(sample: DataFrame, vocabulary: int) -> list[bytes]:
    """The words of three texts or more, those of the most texts first, counted over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            often: Counter = Counter()
            for text in text_bytes(batch.column(0)):
                often.update(set(words_of(text)))
            yield pa.RecordBatch.from_arrays([pa.array(list(often), pa.binary()), pa.array(list(often.values()), pa.int64())], names=["word", "many"])

    counted = sample.select("text").mapInArrow(run, "word binary, many long").groupBy("word").agg(F.sum("many").alias("many"))
    return [row.word for row in counted.where("many >= 3").orderBy(F.desc("many"), "word").limit(vocabulary).collect()]


def _first_windows(sample: DataFrame, look: int) -> list[Window]:
    """As many windows of one label as of the other, ``look`` at most: those of all windows with the smallest hashes."""

    def count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = [len(windows_of(len(words_of(text)))) for text in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(many, pa.int64())], names=["label", "many"])

    counted = sample.select("label", "text").mapInArrow(count_windows, "label int, many long").groupBy("label").agg(F.sum("many").alias("many"))
    counts = {row.label: row.many for row in counted.collect()}
    many = min(look, counts.get(0, 0), counts.get(1, 0))
    if not many:
        return []
    below = {label: min(1.0, (many + 10 * many**0.5) / count) for label, count in counts.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
                found = words_of(text)
                for start, stop in windows_of(len(found)):
                    place = xxhash.xxh64_intdigest(f"{doc}:{start}") >> 1
                    if place < below[label] * (1 << 63):
                        rows.append({"place": place, "doc": doc, "start": start, "label": label, "words": b" ".join(found[start:stop])})
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    shape = pa.schema([("place", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("label", pa.int32()), ("words", pa.binary())])
    rows = sample.select("id", "label", "text").mapInArrow(run, "place long, doc long, start long, label int, words binary").collect()
    rows.sort(key=lambda row: (row.place, row.doc, row.start))
    return [(label, bytes(row.words)) for label in (0, 1) for row in [r for r in rows if r.label == label][:many]]


def _worst_windows(sample: DataFrame, network: Network) -> list[Window]:
    """Of all windows of each text those that score highest: one of a toxic text, three of a clean one."""
    shared = sample.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in _slices(batches):
            labels = batch.column(1).to_pylist()
            rows = [
                {"doc": doc, "place": place, "label": label, "words": words}
                for doc, label, found in zip(batch.column(0).to_pylist(), labels, scorer.worst(text_bytes(batch.column(2)), [1 if x else 3 for x in labels]), strict=True)
                for place, (_, words) in enumerate(found)
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    shape = pa.schema([("doc", pa.int64()), ("place", pa.int64()), ("label", pa.int32()), ("words", pa.binary())])
    rows = sample.select("id", "label", "text").mapInArrow(run, "doc long, place long, label int, words binary").collect()
    shared.destroy()
    rows.sort(key=lambda row: (row.doc, row.place))
    return [(row.label, bytes(row.words)) for row in rows]


def train(sample: DataFrame, look: int = 12_000, vocabulary: int = 8_000, rounds: int = 5, steps: int = 100, seed: int = 0) -> Network:
    """A network from ``sample`` (id, label 0 or 1, text), one row per id, alike at every run.

    Texts stay in Spark's tasks: these count the words, pick the windows of a first look (``look`` of each label at most,
    spread over all windows by hash) and, round by round, score every window of every text with the weights of the moment
    and send back the worst ones. The driver holds windows, and takes at least ``steps`` steps on the first look and on
    all rounds together. Without texts of both labels the network stays untrained and scores near one half.
    """
    rng = np.random.default_rng(seed)
    first = _first_windows(sample, look)
    network = Network.fresh({word: n + 1 for n, word in enumerate(_frequent_words(sample, vocabulary))}, seed)
    if not first:
        return network
    trainer = Trainer(network)

    def teach(windows: list[Window], least: int, size: int = 256) -> None:
        begun = trainer.at
        while trainer.at == begun or trainer.at - begun < least:
            order = rng.permutation(len(windows))
            for at in range(0, len(order), size):
                chosen = [windows[n] for n in order[at : at + size].tolist()]
                found = [words.split() for _, words in chosen]
                place: dict[bytes, int] = {}
                codes = np.array([place.setdefault(w, len(place)) for words in found for w in words], np.int64)
                stops = np.cumsum([len(words) for words in found])
                rows, mask = _padded(np.stack([np.r_[0, stops[:-1]], stops], axis=1), codes)
                trainer.step(list(place), rows, mask, np.array([label for label, _ in chosen], np.float32))

    teach(first, steps)  # every window of a toxic text counts as toxic
    del first
    for _ in range(rounds):
        worst = _worst_windows(sample, network)
        toxic = [w for w in worst if w[0]]
        teach(worst + toxic * ((len(worst) - len(toxic)) // (3 * len(toxic))), -(-steps // rounds))
        trainer.rate = max(0.002, 0.7 * trainer.rate)
    return network


def labelled_sample(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, per_label: int = 1500) -> DataFrame:
    """(id, label, text) of labelled documents outside a fold: at most ``per_label`` of each label, smallest hash of id first.

    Rows with a null id, text or label teach nothing. A document with both labels counts as toxic; of several texts of one
    id the first in order counts.
    """
    marked = labels.where(F.col("toxic").isNotNull() & ~in_fold("doc_id", folds, fold))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.max("toxic") > 0).cast("int").alias("label"))
    texts = docs.where("text is not null and doc_id is not null")
    texts = texts.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    chosen = some_of_each(marked.join(texts.select("id").distinct(), "id"), "label", per_label)
    ids = docs.sparkSession.createDataFrame(chosen, "id long, label int")  # 2 * per_label rows at most
    found = texts.join(F.broadcast(ids), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    return written(found.repartition(parts(docs.sparkSession), "id"), "labelled")


def learn(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, per_label: int = 1500, **options) -> Network:
    """A network from a sample of labelled documents outside a fold (``labelled_sample``), ``options`` going to ``train``."""
    return train(labelled_sample(docs, labels, folds, fold, per_label), **options)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row from the text alone; null, empty and wordless texts score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(network)  # some hundred kB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in _slices(batches):
            values = scorer.scores(text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["doc_id", "score"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, fold: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; repeated rows are scored alike."""
    found = score(docs, learn(docs, labels, folds, fold))
    predicted = F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    return found.select("doc_id", in_fold("doc_id", folds, fold).alias("held_out"), "score", predicted)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, with all their columns; learns outside one fold.

    Null, empty and wordless texts score 0 and stay, as do rows with a null id whose text is clean; repeated rows are
    decided alike, each by its text. An empty table gives an empty one. Without labels of both kinds the network knows
    nothing and scores near one half, so all rows stay. The score rides along as the rows pass, so nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in _slices(batches):
            values = scorer.scores(text_bytes(batch.column(names.index(text_col))))
            yield batch.filter(pa.array([value < threshold for value in values], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
