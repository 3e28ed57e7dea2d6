"""Token counts, BPE, toxicity, quality, language model: against independent versions and on awkward input."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from ambergrid.llm import bpe, kernel, lm, quality, queries, toxicity

ODD = ["", " ", None, "a", "  a  b\n\n c\t", "it's we'll 'tis", "é中文 ñ 🙂 x y", "a" * 30000, "ab " * 5000, "!!!???...", "\x1c \x1d", "same text", "same text"]
AWKWARD = [(i if i % 5 else None, t, "n", 1) for i, t in enumerate(ODD)]
SCHEMA = "doc_id long, text string, n_tokens string, word int"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.VOCABULARY), special_tokens={})


def docs(spark, sf_dir, columns="doc_id, text"):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(*columns.split(", "))


def test_counts_and_ids_equal_an_independent_encoder(spark, sf_dir, reference):
    want = {r["doc_id"]: reference.encode_ordinary(r["text"]) for r in docs(spark, sf_dir).collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in queries.op1_token_counts(spark, sf_dir).collect()} == {k: len(v) for k, v in want.items()}
    rows = queries.op6_byte_bpe(spark, sf_dir).collect()
    assert {r["doc_id"]: r["token_ids"] for r in rows} == want and all(r["exact"] for r in rows)


def test_bpe_on_random_text(reference):
    rng = random.Random(1)
    count, encode = bpe._cached("count", bpe.VOCABULARY), bpe._cached("encode", bpe.VOCABULARY)
    for _ in range(2000):
        text = "".join(rng.choice("ab  \n\t'sé9!ñ中 re ll Z") for _ in range(rng.randint(1, 60)))
        ids = reference.encode_ordinary(text)
        assert sum(count(text)) == len(ids) and np.frombuffer(b"".join(encode(text)), np.int32).tolist() == ids


def test_heap_against_plain_merging():
    ranks = bpe.load_ranks(bpe.VOCABULARY)
    rng = random.Random(2)
    for _ in range(300):
        word = bytes(rng.choice(b"abcdethinger ") for _ in range(rng.randint(0, 40)))
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1 and (best := min((ranks.get(parts[i] + parts[i + 1], 10**9), i) for i in range(len(parts) - 1)))[0] < 10**9:
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert bpe.count_merged(word, ranks) == len(parts)


def test_bpe_awkward(awkward, nothing, reference):
    counted = bpe.count_tokens(awkward).collect()
    assert [r["n_tokens"] for r in counted] == [None if t is None else len(reference.encode_ordinary(t)) for t in ODD]
    assert [r["doc_id"] for r in counted] == [r[0] for r in AWKWARD]
    encoded = bpe.encode(awkward)
    assert [r["text"] for r in bpe.decode(encoded).collect()] == ODD
    for f in (bpe.count_tokens, bpe.encode, bpe.round_trip):
        assert f(nothing).collect() == []
    with pytest.raises(Exception, match="no token has the id"):
        bpe.decode(nothing.sparkSession.createDataFrame([(1, [10**8])], "doc_id long, token_ids array<int>")).collect()


def test_caches_keep_results_when_full(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    pieces = bpe._Pieces(len)
    words = ["a", "bb", "ccc", "dddd", "a", "eeeee", "bb", "a"] * 3
    assert [pieces[w] for w in words] == list(map(len, words)) and len(pieces) + len(pieces.old) <= 7


def test_words_and_their_hashes():
    texts = ["", None, "Ab-c ab", "é É!", "x" * 700_000 + " y", " lead", "trail ", "a b c d e f"]
    w = kernel.lowered_words(pa.array(texts))
    assert np.diff(w.offset).tolist() == [0, 0, 3, 2, 2, 1, 1, 6]
    assert w.hash[0] == w.hash[2] and w.hash[3] == w.hash[4] and len(set(w.hash[-6:].tolist())) == 6
    again = kernel.lowered_words(pa.array(["c zz ab"]), (1,))
    assert again.hash[0] == w.hash[1] and again.hash[2] == w.hash[0] and again.prefix[1][0] != again.prefix[1][1]


def test_toxicity_finds_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = docs(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    train = labels.where("pmod(doc_id, 3) > 0")  # the rest of the labels is never seen
    scored = toxicity.score(d, toxicity.fit(d, train)).join(labels.where("pmod(doc_id, 3) = 0"), "doc_id").toPandas()
    toxic, clean = scored[scored.toxic == 1], scored[scored.toxic == 0]
    assert toxic.is_toxic.mean() > 0.9 and clean.is_toxic.mean() < 0.02


def corrected_risk(z_p, z_u, prior):
    return prior * np.mean(np.log1p(np.exp(-z_p))), np.mean(np.log1p(np.exp(z_u))) - prior * np.mean(np.log1p(np.exp(z_p)))


def test_slopes_are_those_of_the_corrected_risk():
    rng = np.random.default_rng(2)
    z_p, z_u = rng.normal(0, 1, 5), rng.normal(0, 1, 7)
    for shift, sign_p, sign_u in ((0.0, 1, 1), (-6.0, 0, -1)):  # far below zero the unlabelled part is negative
        u = z_u + shift
        first, second = corrected_risk(z_p, u, 0.6)
        assert (second < 0) == (sign_u < 0)
        goal = lambda p, x: sign_p * corrected_risk(p, x, 0.6)[0] + sign_u * corrected_risk(p, x, 0.6)[1]  # noqa: E731, B023
        slope_p, slope_u = toxicity.slopes(z_p, u, 0.6)
        for k in range(5):
            assert slope_p[k] == pytest.approx((goal(z_p + 1e-5 * np.eye(5)[k], u) - goal(z_p - 1e-5 * np.eye(5)[k], u)) / 2e-5, abs=1e-6)
        for k in range(7):
            assert slope_u[k] == pytest.approx((goal(z_p, u + 1e-5 * np.eye(7)[k]) - goal(z_p, u - 1e-5 * np.eye(7)[k])) / 2e-5, abs=1e-6)


def test_risk_goes_back_when_negative(monkeypatch):
    """Unlabelled documents like the positives' opposites drive the risk below zero; only the correction holds weights back."""
    x_p, x_u = np.ones((40, 1)), -np.ones((40, 1))
    held = abs(toxicity.descend(x_p, x_u, 0.5, decay=0)[0][0])
    plain = lambda p, u, prior: (np.full(len(p), -prior / len(p)), 1 / (1 + np.exp(-u)) / len(u))
    monkeypatch.setattr(toxicity, "slopes", plain)
    assert held < 0.8 * abs(toxicity.descend(x_p, x_u, 0.5, decay=0)[0][0])


def plain_toxicity(rows, positive, prior):
    """The whole estimator with dictionaries and double precision, for tables of one chunk."""
    shares = []
    for text in rows:
        w = kernel.lowered_words(pa.array([text]), toxicity.PREFIXES)
        found = [int(h) >> (64 - toxicity.BITS) for hs in (w.hash, *w.prefix.values()) for h in hs.tolist()]
        shares.append({f: min(found.count(f) / len(found), toxicity.CLIP) for f in set(found)} if found else None)
    docs = [s for s in shares if s is not None]
    toxic = [shares[i] for i in positive if shares[i] is not None]
    names = sorted({f for s in docs for f in s})
    table = lambda sets: np.array([[s.get(f, 0.0) for f in names] for s in sets])
    u, p = table(docs), table(toxic)
    t = np.abs(p.mean(0) - u.mean(0)) / np.sqrt(u.var(0) / len(u) + p.var(0) / len(p) + (1e-3 / len(p)) ** 2)
    best = [k for k in np.lexsort((names, -t)) if t[k] >= toxicity.LEAST_T][: toxicity.KEEP]
    scale = np.sqrt(u[:, best].var(0) + (0.1 * toxicity.CLIP) ** 2 / len(u))
    x_p, x_u = p[:, best] / scale, u[:, best] / scale
    w, bias, m, v = np.zeros(len(best)), np.log(prior / (1 - prior)), np.zeros(len(best) + 1), np.zeros(len(best) + 1)
    for step in range(1, 301):
        z_p, z_u = x_p @ w + bias, x_u @ w + bias
        s_p, s_u = 1 / (1 + np.exp(-z_p)), 1 / (1 + np.exp(-z_u))
        if np.mean(np.log1p(np.exp(z_u))) - prior * np.mean(np.log1p(np.exp(z_p))) < 0:
            g_p, g_u = prior * s_p / len(p), -s_u / len(u)
        else:
            g_p, g_u = np.full(len(p), -prior / len(p)), s_u / len(u)
        g = np.append(g_p @ x_p + g_u @ x_u + 3e-3 * w, g_p.sum() + g_u.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    weight = dict(zip([names[k] for k in best], w / scale, strict=True))
    out = []
    for text in rows:
        h = kernel.lowered_words(pa.array([text]), toxicity.PREFIXES)
        found = [int(x) >> (64 - toxicity.BITS) for hs in (h.hash, *h.prefix.values()) for x in hs.tolist()]
        out.append(1 / (1 + np.exp(-bias - np.mean([weight.get(f, 0.0) for f in found]))) if found else 0.0)
    return out


def test_toxicity_query_equals_the_plain_estimator(spark, sf_dir):
    rows = docs(spark, sf_dir).orderBy("doc_id").collect()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    known = labels.groupby("doc_id").toxic.max()
    hit = set(known[known == 1].index)
    want = plain_toxicity([r["text"] for r in rows], [i for i, r in enumerate(rows) if r["doc_id"] in hit], len(hit) / len(known))
    got = {r["doc_id"]: r for r in queries.op2_toxicity(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    assert max(abs(got[r["doc_id"]]["toxicity"] - p) for r, p in zip(rows, want, strict=True)) < 0.02


def test_toxicity_averages_over_chunks(spark, monkeypatch):
    """Cut into many chunks, the averaged model still finds what the single one finds."""
    sf = "/root/testdata/sf0.1"
    d, labels = docs(spark, sf).limit(4000).repartition(3, "doc_id"), spark.read.parquet(f"{sf}/labels.parquet")
    one = toxicity.score(d, toxicity.fit(d.coalesce(1), labels)).toPandas().set_index("doc_id").is_toxic
    monkeypatch.setattr(toxicity, "CHUNK", 700)
    many = toxicity.score(d, toxicity.fit(d, labels)).toPandas().set_index("doc_id").is_toxic
    assert one.sum() > 50 and (one == many.reindex(one.index)).mean() > 0.99


def test_a_toxic_id_that_repeats_is_one_positive(spark):
    rows = [(1, "vile horrid words here")] * 500 + [(i, f"plain nice text number w{i} of many") for i in range(2, 300)] + [(i, f"vile horrid w{i}") for i in range(300, 330)]
    labels = [(1, 1)] + [(i, int(i >= 300)) for i in range(2, 330)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.score(d, toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
    assert len(got) == len(rows)


def test_toxicity_awkward(awkward, nothing):
    labels = awkward.sparkSession.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (None, 1), (11, 1)], "doc_id long, toxic int")
    model = toxicity.fit(awkward, labels)
    rows = toxicity.score(awkward, model).collect()
    assert len(rows) == len(ODD) and all(r["toxicity"] == 0 and not r["is_toxic"] for r, t in zip(rows, ODD, strict=True) if not t or not t.strip())
    assert rows[-1]["toxicity"] == rows[-2]["toxicity"]
    kept = toxicity.keep_clean(awkward, model)
    assert kept.columns == awkward.columns and kept.count() == sum(not r["is_toxic"] for r in rows)
    none = toxicity.fit(nothing, labels.limit(0))
    assert toxicity.score(nothing, none).collect() == [] and not any(r["is_toxic"] for r in toxicity.score(awkward, none).collect())


def test_quality_keeps_clean_and_drops_junk(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = docs(spark, sf), spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "label")
    scored = quality.score(d, quality.fit(d)[1]).join(labels, "doc_id").toPandas()  # labels are only used here
    assert scored[scored.label == 1].keep.mean() > 0.99 and scored[scored.label == 0].keep.mean() < 0.05


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.8
    right = np.array([[0.9, 0.6, 0.8, 0.7], [0.99, 0.98, 0.97, 0.99]])
    votes = np.stack([np.where(rng.random(20000) < np.where(truth, right[1, j], right[0, j]), truth, ~truth).astype(int) for j in range(4)], 1)
    votes[rng.random(votes.shape) < 0.2] = quality.ABSTAIN
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_labellers(patterns, counts.astype(float))
    assert abs(model.share - 0.8) < 0.03 and np.abs(model.right - right).max() < 0.05


def test_quality_awkward(awkward, nothing):
    model, scorer = quality.fit(awkward)
    rows = quality.score(awkward, scorer).collect()
    assert len(rows) == len(ODD) and [r["quality"] for r, t in zip(rows, ODD, strict=True) if t is None or len(t.encode()) < 3] == [0, 0, 0, 0]
    kept = quality.keep_good(awkward, scorer)
    assert kept.columns == awkward.columns and kept.count() == sum(r["keep"] for r in rows)
    assert quality.score(nothing, quality.fit(nothing)[1]).collect() == []


def test_language_model_query_beats_unigrams(spark, sf_dir):
    d = docs(spark, sf_dir)
    rows = queries.op8_lm_scores(spark, sf_dir).collect()
    assert len(rows) == d.count()
    for r in rows:
        assert r["n_tokens"] == len(r["token_logprobs"]) and r["mean_logprob"] == pytest.approx(np.mean(r["token_logprobs"]), abs=1e-4) and max(r["token_logprobs"]) < 0
    n = np.array([r["n"] for r in lm.count_words(d, "text").collect()])
    assert sum(sum(r["token_logprobs"]) for r in rows) / n.sum() > (n / n.sum() * np.log(n / n.sum())).sum()


@pytest.mark.parametrize("heads", [65_536, 50])
def test_scores_equal_plain_softmax_and_counts(spark, sf_dir, monkeypatch, heads):
    """With a fixed model, every probability by dictionaries: softmax over classes times the word's share of its class."""
    monkeypatch.setattr(lm, "HEADS", heads)
    monkeypatch.setattr(lm, "train", lambda encoded, counts: lm.start(counts)[0])
    d = docs(spark, sf_dir).where("doc_id < 60 and length(text) < 3000")
    texts = {r["doc_id"]: kernel.lowered_words(pa.array([r["text"]])).hash.tolist() for r in d.collect()}
    count = collections.Counter(h for t in texts.values() for h in t)
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    frequent = {h: i + 1 for i, h in enumerate(sorted(count, key=lambda h: (-count[h], signed(h)))[: lm.FREQUENT])}
    of = {h: frequent.get(h, 1 + lm.FREQUENT + h % lm.BUCKETS) for h in count}
    total = collections.Counter()
    for h, n in count.items():
        total[of[h]] += n
    model = lm.start(np.array([total[c] for c in range(lm.VOCABULARY)]))[0]
    for r in lm.score(d).collect():
        one = two = 0
        for h, got in zip(texts[r["doc_id"]], r["token_logprobs"], strict=True):
            s = model.output.astype(float) @ (model.input[one] * model.position[0] + model.input[two] * model.position[1]) + model.bias
            p = np.exp(s - s.max())
            want = np.log(p[of[h]] / p[1:].sum()) + np.log(count[h] / total[of[h]])
            assert got == pytest.approx(want, abs=2e-3)
            one, two = of[h], one


def test_descent_equals_plain_noise_contrastive_estimation():
    """One minibatch by loops over trigrams and noise words."""
    counts = np.zeros(lm.VOCABULARY, np.int64)
    counts[1:9] = [40, 30, 20, 10, 5, 4, 3, 2]
    model, noise = lm.start(counts)
    trigrams = {(0, 0, 1): 5, (0, 1, 2): 3, (1, 2, 3): 2, (2, 3, 4): 1, (1, 2, 1): 4}
    codes = np.array([(a << 20) | (b << 10) | c for a, b, c in trigrams], np.int32)
    got = lm.descend(model, codes, np.array(list(trigrams.values())), noise, seed=3)
    rng = np.random.default_rng(3)
    rng.permutation(len(codes))
    fakes = np.minimum(np.searchsorted(np.cumsum(noise), rng.random(lm.NOISE) * np.cumsum(noise)[-1], side="right"), lm.VOCABULARY - 1)
    inp, out, bias, position = (np.array(x, float) for x in model)
    g_in, g_out, g_bias, g_pos = (np.zeros_like(x) for x in (inp, out, bias, position))
    for (two, one, word), n in trigrams.items():
        h, weight = inp[one] * position[0] + inp[two] * position[1], n / sum(trigrams.values())
        back = np.zeros(lm.DIM)
        for w, real in [(word, True), *((f, False) for f in fakes)]:
            odds = h @ out[w] + bias[w] - np.log(lm.NOISE * noise[w] + 1e-12)
            slope = weight * (1 / (1 + np.exp(-odds)) - real)  # of -log P(real or noise)
            g_out[w] += slope * h
            g_bias[w] += slope
            back += slope * out[w]
        g_in[one] += back * position[0]
        g_in[two] += back * position[1]
        g_pos += back * np.stack([inp[one], inp[two]])
    for old, g, new, least in ((inp, g_in, got.input, 1e-4), (out, g_out, got.output, 1e-4), (bias, g_bias, got.bias, 1e-4), (position, g_pos, got.position, 1e-2)):
        square = g * g if old is bias or old is position else (g * g).mean(1, keepdims=True)
        assert np.allclose(old - lm.RATE * g / np.sqrt(least + square), new, atol=1e-4)


def test_tables_equal_plain_softmax():
    model, _ = lm.start(np.arange(lm.VOCABULARY, dtype=np.int64))
    h = model.input[7] * model.position[0] + model.input[300] * model.position[1]
    s = (model.output @ h + model.bias).astype(float)
    s[0] = -1e9
    want = s[42] - np.log(np.exp(s - s.max()).sum()) - s.max()
    assert lm.Tables(model).log_probabilities(np.array([(300 << 20) | (7 << 10) | 42], np.int32))[0] == pytest.approx(want, abs=1e-4)


def test_trigrams_of_short_lists():
    lists = [np.array(x, np.int16).tobytes() for x in ([5], [], [6, 7, 8])] + [None]
    codes, size = lm.trigram_codes(lists)
    assert size.tolist() == [1, 0, 3, 0]
    assert [(c >> 20, (c >> 10) & 1023, c & 1023) for c in codes.tolist()] == [(0, 0, 5), (0, 0, 6), (0, 6, 7), (6, 7, 8)]


def test_language_model_awkward(awkward, nothing):
    rows = lm.score(awkward).collect()
    assert sorted((r["doc_id"] for r in rows), key=str) == sorted((r[0] for r in AWKWARD), key=str)
    size = {i: None if t is None else len(kernel.lowered_words(pa.array([t])).hash) for i, t, *_ in AWKWARD if i}
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"]}
    assert {i: r["n_tokens"] for i, r in by_id.items()} == size and all((r["mean_logprob"] is None) == (not r["n_tokens"]) for r in rows)
    assert by_id[11]["mean_logprob"] == pytest.approx(by_id[12]["mean_logprob"], abs=1e-9)
    assert lm.score(nothing).collect() == []
