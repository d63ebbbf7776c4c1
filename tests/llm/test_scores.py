import numpy as np
import pytest

from tests.llm.conftest import prose
from thornwall.llm import langid, toxicity
from thornwall.llm.queries import QUERIES


def test_held_out_languages(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op5_language"](spark, folder).collect()
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 150 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_filters_return_every_language_of_a_gram():
    members = [np.unique(np.random.default_rng(n).integers(0, 1 << 63, 3000).astype(np.uint64)) for n in range(3)]
    filters = langid.Filters.of(["a", "b", "c"], members)
    for bit, hashes in enumerate(members):
        assert ((filters.masks(hashes)[0] >> bit) & 1).all()
    strange = np.random.default_rng(9).integers(0, 1 << 63, 20000).astype(np.uint64)
    for bit in range(3):
        share = ((filters.masks(strange)[0] >> bit) & 1).mean()
        assert share == pytest.approx(filters.chance[bit], abs=0.02)


def test_grams_match_plain_slicing():
    text = "Ab  é-x9 cde"
    folded = " ab é x cde "
    pieces = [folded[i : i + n] for n in langid.SIZES for i in range(len(folded) - n + 1)]
    wanted = [p for p in pieces if " " not in p[1:-1]]
    assert len(langid.grams(langid._points(text))) == len(wanted)


def plain_language(known, text):
    """Counts n-grams one by one over sets, with no filter and so no chance hits; known: n-grams of each language."""
    folded = "".join(c if c.isalpha() else " " for c in text.lower())
    folded = " " + " ".join(folded.split()) + " "
    pieces = [folded[i : i + n] for n in langid.SIZES for i in range(len(folded) - n + 1)]
    pieces = [p for p in pieces if " " not in p[1:-1]]
    return {lang: sum(p in own for p in pieces) for lang, own in known.items()}


def test_more_languages_than_a_mask_has_bits_agree_with_plain_counting(spark):
    rng = __import__("random").Random(11)
    letters = {f"l{n:02}": rng.sample("abcdefghijklmnopqrstuvwxyzäöüßéèñøåçœšžþðγδλπσωжзийклмнопрст", 12) for n in range(70)}
    text = lambda lang, many: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 7))) for _ in range(many))
    rows = [(n, text(lang, 60), lang) for n, lang in enumerate(list(letters) * 6)]
    filters = langid.learn(spark.createDataFrame(rows, "id long, text string, lang string").repartition(4))
    assert filters.names == sorted(letters) and len(filters.tables) == 2
    grams = {}
    for _, body, lang in rows:
        own = grams.setdefault(lang, set())
        folded = f" {body} "
        own |= {folded[i : i + n] for n in langid.SIZES for i in range(len(folded) - n + 1) if " " not in folded[i + 1 : i + n - 1]}
    asked = [(n, text(lang, 40), lang) for n, lang in enumerate(list(letters) * 2)]
    got = langid.identify(spark.createDataFrame(asked, "doc_id long, text string, lang string"), filters).collect()
    right = 0
    for r in got:
        counts = plain_language(grams, asked[r.doc_id][1])
        lead = sorted(counts.values())[-2:]
        if lead[1] - lead[0] > 10:  # beyond what chance hits change
            assert r.lang_pred == max(counts, key=counts.get)
        right += r.lang_pred == asked[r.doc_id][2]
    assert right >= 0.95 * len(asked)


def test_odd_texts_have_a_language_or_none(odd, none):
    labelled = odd.selectExpr("doc_id as id", "text", "lang")
    filters = langid.learn(labelled)
    assert filters.names == ["en"]
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(odd, filters).collect()}
    assert {(0, "und"), (1, "und"), (2, "und"), (3, "en"), (None, "und")} <= got
    assert langid.language_report(none).count() == 0
    assert langid.learn(labelled.limit(0)).predict("some text") == ("und", 0.0)


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    network = toxicity.Network.fresh({b"bad": 1, b"good": 2})
    network.weights = {k: (v + rng.normal(size=v.shape) * 0.3).astype(np.float64) for k, v in network.weights.items()}
    words = [b"bad", b"good", b"thing", b"x"]
    rows = rng.integers(0, 4, (5, 7))
    mask = (np.arange(7) < np.array([7, 3, 1, 5, 6])[:, None]).astype(np.float64)
    target = np.array([1.0, 0, 1, 0, 0])

    def loss():
        p = network.forward(network.gates(network.inputs(words)[0])[rows.T], mask.T)
        return -(target * np.log(p) + (1 - target) * np.log(1 - p)).mean()

    seen = {}

    class Spy(toxicity.Trainer):
        def step(self, *a):
            self.first = {k: np.zeros_like(v) for k, v in self.network.weights.items()}
            before = {k: v.copy() for k, v in self.network.weights.items()}
            super().step(*a)
            seen.update({k: v / 0.1 for k, v in self.first.items()})
            self.network.weights.update(before)

    Spy(network).step(words, rows, mask, target)
    for name, weight in network.weights.items():
        flat = weight.reshape(-1)
        places = np.flatnonzero(seen[name].reshape(-1)) if name in ("words", "chars") else np.arange(len(flat))
        for i in rng.choice(places, min(6, len(places)), replace=False):
            old, step = flat[i], 1e-3
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert seen[name].reshape(-1)[i] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-4), name


def _labelled(rng, many):
    texts, labels = [], []
    for i in range(many):
        words = prose(rng, rng.randint(5, 200)).split()
        if i % 2:
            for place in rng.sample(range(len(words)), 2):
                words[place] = rng.choice(["awful", "nasty", f"vile{rng.choice('abcdefgh')}"])
        texts.append(" ".join(words))
        labels.append(i % 2)
    return texts, labels


def test_a_trained_network_tells_held_out_texts_apart(spark):
    import random

    rng = random.Random(4)
    texts, labels = _labelled(rng, 400)
    docs = spark.createDataFrame([(i, t, "en", None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, score int").repartition(4)
    marks = spark.createDataFrame([(i, n, None) for i, n in enumerate(labels)] + [(None, 1, 1), (3, None, None)], "doc_id long, toxic int, score int")
    got = toxicity.toxicity_report(docs, marks).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 400 and 100 < len(held) < 170
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, marks).collect()}
    assert kept == {r.doc_id for r in got if not r.predicted}


def test_windows_cover_every_word_and_overlap():
    for many in (0, 1, 16, 17, 32, 33, 48, 49, 1000):
        windows = toxicity.windows_of(many)
        assert sorted({i for a, b in windows for i in range(a, b)}) == list(range(many))
        assert all(b - a <= toxicity.WINDOW for a, b in windows)
        assert all(x[1] - y[0] >= toxicity.STRIDE for x, y in zip(windows, windows[1:]))


def test_odd_texts_score_from_0_to_1(odd, none):
    network = toxicity.Network.fresh({})
    got = [(r.doc_id, r.score) for r in toxicity.score(odd, network).collect()]
    assert len(got) == odd.count() and all(0 <= s <= 1 for _, s in got) and (0, 0.0) in got and (1, 0.0) in got
    assert toxicity.toxicity_report(none, none.selectExpr("doc_id", "score as toxic")).count() == 0
    assert toxicity.drop_toxic(none, none.selectExpr("doc_id", "score as toxic")).count() == 0


def _sample(spark, texts, labels):
    rows = [(i, n, t) for i, (t, n) in enumerate(zip(texts, labels, strict=True))]
    return spark.createDataFrame(rows, "id long, label int, text string").repartition(3)


def test_the_score_is_that_of_the_worst_window(spark):
    texts, labels = _labelled(__import__("random").Random(2), 60)
    network = toxicity.train(_sample(spark, texts, labels), steps=20, rounds=2)
    scorer = toxicity.Scorer(network)
    for text, value in zip(texts[:20], scorer.scores([t.encode() for t in texts[:20]]), strict=True):
        words = toxicity.words_of(text.encode())
        alone = [scorer.windows(words, [span])[0] for span in toxicity.windows_of(len(words))]
        assert value == pytest.approx(max(alone), abs=1e-5)


def plain_score(network, text):
    """The network word by word and window by window, without batches, padding or remembered words."""
    w = {k: v.astype(float) for k, v in network.weights.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    words = toxicity.words_of(text.encode())
    best = 0.0
    for first, last in toxicity.windows_of(len(words)):
        vectors = []
        for word in words[first:last]:
            rows, _ = toxicity.char_grams([word])
            chars = sum((w["chars"][r] for r in rows), np.zeros(toxicity.CHAR)) / np.sqrt(max(1, len(rows)))
            vectors.append(np.concatenate([w["words"][network.vocabulary.get(word, 0)], chars]))
        sides = []
        for way, order in (("f", 1), ("b", -1)):
            state, states, h = np.zeros(toxicity.HIDDEN), [], toxicity.HIDDEN
            for x in vectors[::order]:
                gates = x @ w[f"in_{way}"] + w[f"bias_{way}"]
                update, reset = (sigmoid(gates[n * h : (n + 1) * h] + state @ w[f"re_{way}"][:, n * h : (n + 1) * h]) for n in (0, 1))
                fresh = np.tanh(gates[2 * h :] + (reset * state) @ w[f"re_{way}"][:, 2 * h :])
                state = state + update * (fresh - state)
                states.append(state)
            sides.append(states[::order])
        hidden = np.concatenate([np.array(side) for side in sides], axis=1)
        share = np.exp(np.tanh(hidden @ w["look"]) @ w["ask"])
        best = max(best, float(sigmoid((share / share.sum()) @ hidden @ w["out"] + w["bias"])[0]))
    return best


def test_the_query_scores_like_a_plain_network(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    network = toxicity.learn(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = QUERIES["op6_toxicity"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    short = [r for r in got if len(texts[r.doc_id]) < 4000][:60]
    for r in short:
        assert r.score == pytest.approx(plain_score(network, texts[r.doc_id]), abs=1e-4)
        assert r.predicted == int(r.score >= 0.7)


def test_some_of_each_group_are_those_with_the_smallest_hashes(spark):
    from pyspark.sql import functions as F

    from thornwall.llm.common import some_of_each

    rows = spark.range(20000).select("id", F.when(F.col("id") % 50 == 0, "b").otherwise("a").alias("side"))
    rows = rows.unionByName(rows.limit(100))
    place = F.shiftrightunsigned(F.xxhash64("id"), 11)
    expected = []
    for side in "ab":
        ids = rows.where(F.col("side") == side).distinct().orderBy(place, "id").limit(30).collect()
        expected += [(r.id, side) for r in ids]
    assert sorted(some_of_each(rows, "side", 30)) == sorted(expected)
    assert some_of_each(rows.limit(0), "side", 3) == []


def test_all_of_a_run_without_spaces_is_scored():
    run = "".join(chr(0x4E00 + 7 * i) for i in range(300))
    for word in (run.encode(), b"x" * 20 + bytes(range(97, 123)) * 40, ("ab" + run).encode(), b"\x80" * 200):
        words = toxicity.words_of(word)
        assert max(map(len, words)) <= toxicity.PIECE
        assert {word[i : i + 5] for i in range(len(word) - 4)} == {w[i : i + 5] for w in words for i in range(len(w) - 4)}
    assert all(w.decode() in run for w in toxicity.words_of(run.encode()))
    assert toxicity.words_of("Ab\u00a0c\u3000d\u2009e\u0085f".encode()) == [b"ab", b"c", b"d", b"e", b"f"]
    network = toxicity.Network.fresh({}, 1)
    network.weights["chars"] = np.random.default_rng(1).normal(size=network.weights["chars"].shape).astype(np.float32)
    texts = [(run + end).encode() for end in ("\u6bd2\u6bd2\u6bd2", "\u82b1\u82b1\u82b1")]
    texts += [("x" * 100 + end).encode() for end in ("good", "vile")]
    scores = toxicity.Scorer(network).scores(texts)
    assert scores[2] != scores[3]
    last = [toxicity.Scorer(network).windows(words, toxicity.windows_of(len(words)))[-1] for words in map(toxicity.words_of, texts[:2])]
    assert last[0] != last[1]


def test_every_window_of_a_long_text_is_looked_at(spark, monkeypatch):
    rng = __import__("random").Random(6)
    texts, labels = _labelled(rng, 40)
    texts.append(prose(rng, 90000) + " awful nasty vilea " + prose(rng, 90000))
    network = toxicity.Network.fresh({b"awful": 1, b"nasty": 1, b"vilea": 1})
    network.weights["words"][1] = 3
    network.weights["chars"][:] = 0
    network.weights["out"] = np.sign(toxicity.Scorer(network).network.weights["out"]) * 2
    sample = _sample(spark, texts, [*labels, 1])
    one = max(toxicity.Scorer(network).scores([b"awful nasty vilea", b"other plain words"]))
    if toxicity.Scorer(network).scores([b"awful nasty vilea"])[0] < one:
        network.weights["out"] *= -1
    worst = toxicity._worst_windows(sample, network)
    assert len(worst) == 21 + 3 * 20 - sum(max(0, 3 - len(toxicity.windows_of(len(t.split())))) for t, n in zip(texts, labels) if not n)
    assert b"awful nasty vilea" in worst[-1][1]
    first = toxicity._first_windows(sample, 50)
    assert [n for n, _ in first] == [0] * 50 + [1] * 50
    assert len(toxicity._first_windows(sample, 10**6)) == 2 * sum(len(toxicity.windows_of(len(t.split()))) for t, n in zip(texts, labels) if not n)
    assert toxicity._frequent_words(sample, 5) == sorted(toxicity._frequent_words(sample, 5), key=lambda w: (-sum(w in toxicity.words_of(t.encode()) for t in texts), w))
