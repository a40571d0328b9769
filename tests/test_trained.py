"""Training over several batches against numpy; prepared inputs, stored models and studies against brute force."""
import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagesieve import constants as K
from pagesieve.functions import grams as GR
from pagesieve.operators import clean as CL
from pagesieve.operators import model as MD
from pagesieve.operators import ngrams as NG
from pagesieve.operators import training as TR

TEXTS = ["good solid reporting here", "cheap pills buy now now", "a careful long analysis", "click here for free money",
         "", "balanced view of events", "buy cheap money now", "long view of careful events here"]
LABELS = [0, 1, 0, 1, 1, 0, 1, 0]


def documents(spark):
    return spark.createDataFrame([(i + 10, t, y) for i, (t, y) in enumerate(zip(TEXTS, LABELS))],
                                 "doc_id long, text string, label int")


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def simulate(docs, cfg, num):
    """``docs``: id -> (label, [[ids of a word] ...], numeric inputs). Plain numpy, one batch after another."""
    nf = num if cfg.with_features else 0
    E, buckets = cfg.emb_size, sorted({b for _, words, _ in docs.values() for w in words for b in w})
    V = {b: 0.1 * MD.np_std_normal([f"{cfg.seed}:v:{b}:{j}" for j in range(E)]) for b in buckets}
    W, bias, losses = MD.init_dense(E + nf, 2, cfg.seed, cfg.with_features), np.zeros(2), []
    names = [f"x{j}" for j in range(E)] + ["z_f"][:nf]
    for epoch in range(cfg.epochs):
        order = sorted(docs, key=lambda d: md5(f"{epoch}-{d}"))
        for bi in range(-(-len(order) // cfg.batch_size)):
            batch = order[bi * cfg.batch_size:(bi + 1) * cfg.batch_size]
            X, Y = [], []
            for d in batch:
                label, words, z = docs[d]
                emb = sum((sum((V[b] for b in w), np.zeros(E)) / len(w) for w in words if w), np.zeros(E)) / max(len(words), 1)
                x = np.concatenate([emb, z[:nf]])
                if cfg.dropout:
                    keep = [(int(md5(f"{cfg.seed}:{epoch}:{bi}:{d}:{c}")[:8], 16) + 0.5) / 2**32 >= cfg.dropout for c in names]
                    x = x * np.array(keep) / (1 - cfg.dropout)
                X.append(x)
                Y.append(label)
            X, Y = np.array(X), np.array(Y)
            z = X @ W + bias
            P = np.exp(z - z.max(1, keepdims=True))
            P /= P.sum(1, keepdims=True)
            reg = np.abs(W).sum() if cfg.with_features else 0.5 * (W ** 2).sum()
            losses.append(-np.log(P[np.arange(len(Y)), Y]).mean() + cfg.reg_lambda * reg)
            G = (P - np.eye(2)[Y]) * (1 / len(Y) if cfg.with_features else 1)
            dW = X.T @ G
            if cfg.with_features:
                dW = dW + cfg.reg_lambda * np.sign(W)
                dW *= min(1, cfg.max_grad_norm / np.linalg.norm(dW))
            else:
                dW = dW + cfg.reg_lambda * W
            W, bias = W - cfg.lr * dW, bias - cfg.lr * G.sum(0)
            for d, g in zip(batch, G @ W[:E].T):
                ids = [b for w in docs[d][1] for b in w]
                for b in set(ids):
                    V[b] = V[b] - cfg.lr * g / len(ids) * (1 if cfg.per_distinct else ids.count(b))
    return V, W, bias, losses


@pytest.mark.parametrize("cfg, merge", [
    (MD.TrainConfig(emb_size=3, lr=0.3, reg_lambda=1e-3, max_grad_norm=0.05, epochs=2, batch_size=3), 2),
    (MD.TrainConfig(emb_size=3, lr=0.1, reg_lambda=1e-2, epochs=1, batch_size=5, with_features=False, per_distinct=False,
                    dropout=0.3), 8)])
def test_several_batches_equal_numpy(spark, monkeypatch, cfg, merge):
    monkeypatch.setattr(MD, "MERGE_EVERY", merge)
    docs = documents(spark)
    occ, enc = NG.word_occurrences(docs, "doc_id", "text"), NG.encode(docs, "doc_id", "text", 3, 4, 1000)
    words = {}
    for r in occ.collect():
        words.setdefault(r.doc_id, {})[r.word_pos] = []
    for r in enc.collect():
        words[r.doc_id][r.word_pos].append(r.bucket)
    z = docs.select("doc_id", (F.length("text") / 10.0 - 2.0).alias("z_f"))
    zf = {r.doc_id: np.array([r.z_f]) for r in z.collect()}
    plain = {i + 10: (y, list(words.get(i + 10, {}).values()), zf[i + 10]) for i, y in enumerate(LABELS)}
    read = []
    real = MD.inputs
    monkeypatch.setattr(MD, "inputs", lambda examples, *a, **k: (read.append(examples.inputFiles()), real(examples, *a, **k))[1])
    vocab, dense, hist = MD.train(MD.doc_bucket_weights(occ, enc), z, docs, cfg, ["f"])
    V, W, bias, losses = simulate(plain, cfg, 1)
    assert np.allclose(dense.W, W, atol=1e-9) and np.allclose(dense.b, bias, atol=1e-9)
    got = {r.bucket: [r[f"e{j}"] for j in range(cfg.emb_size)] for r in vocab.collect()}
    assert got.keys() == V.keys() and all(np.allclose(got[b], V[b], atol=1e-9) for b in V)
    assert np.allclose([r.loss for r in hist.orderBy("epoch", "batch").collect()], losses, atol=1e-9)
    steps = cfg.epochs * -(-len(LABELS) // cfg.batch_size)      # a step reads its own batch's files, no step another's
    assert len(read) == steps and len({f for files in read for f in files}) == sum(map(len, read))
    assert all("batch_id=" in f for files in read for f in files)


@pytest.mark.parametrize("cfg, most", [
    (MD.TrainConfig(emb_size=3, lr=0.3, reg_lambda=1e-3, max_grad_norm=0.05, epochs=2, batch_size=3), 10**6),
    (MD.TrainConfig(emb_size=3, lr=0.3, reg_lambda=1e-3, max_grad_norm=0.05, epochs=2, batch_size=2), 60),
    (MD.TrainConfig(emb_size=3, lr=0.1, reg_lambda=1e-2, epochs=2, batch_size=3, with_features=False, per_distinct=False,
                    dropout=0.3), 10**6)])
def test_blocks_of_batches_equal_single_steps(spark, monkeypatch, cfg, most):
    docs = documents(spark)
    w = MD.doc_bucket_weights(NG.word_occurrences(docs, "doc_id", "text"), NG.encode(docs, "doc_id", "text", 3, 4, 1000))
    z = docs.select("doc_id", (F.length("text") / 10.0 - 2.0).alias("z_f"))
    rows = MD.as_examples(w, z, docs, ["f"])
    rows = rows.unionByName(rows.where("doc_id = 12"))      # rows of one id share its entries in a batch
    steps, blocks = [], []
    for name, into in (("_step", steps), ("_block", blocks)):
        monkeypatch.setattr(MD, name, lambda *a, f=getattr(MD, name), n=into: (n.append(1), f(*a))[1])
    want = MD.train_examples(rows, cfg, ["f"])
    n = len(steps)
    got = MD.train_examples(rows, cfg, ["f"], block_entries=most)
    assert blocks and len(steps) - n + len(blocks) < n       # some batches together; with 60 a wide one is alone
    assert np.allclose(got[1].W, want[1].W, atol=1e-12) and np.allclose(got[1].b, want[1].b, atol=1e-12)
    tables = [{r.bucket: tuple(r)[1:] for r in t[0].select("bucket", "e0", "e1", "e2").collect()} for t in (got, want)]
    assert tables[0].keys() == tables[1].keys() and all(np.allclose(tables[0][b], tables[1][b], atol=1e-12) for b in tables[1])
    losses = [[tuple(r) for r in t[2].orderBy("epoch", "batch").collect()] for t in (got, want)]
    assert [x[:3] for x in losses[0]] == [x[:3] for x in losses[1]]
    assert np.allclose([x[3] for x in losses[0]], [x[3] for x in losses[1]], atol=1e-12)


def test_prepared_inputs_equal_the_encoding(spark):
    docs = documents(spark)
    prep = TR.prepared(spark, docs, TR.Inputs(masked=False, buckets=997))
    got = {(r.doc_id, r.bucket): (r.n_ids, round(r.w, 9), r.occ) for r in MD.entries_of(prep.examples).collect()}
    old = MD.doc_bucket_weights(NG.word_occurrences(docs, "doc_id", "text"), NG.encode(docs, "doc_id", "text", 3, 4, 997))
    assert got == {(r.doc_id, r.bucket): (r.n_ids, round(r.w, 9), r.occ) for r in old.collect()}
    assert {r.doc_id: r.label for r in prep.examples.collect()} == {i + 10: y for i, y in enumerate(LABELS)}
    again = TR.prepared(spark, docs.orderBy(F.desc("doc_id")), TR.Inputs(masked=False, buckets=997))
    assert again.examples.inputFiles() == prep.examples.inputFiles()
    other = TR.prepared(spark, docs.where("doc_id > 11"), TR.Inputs(masked=False, buckets=997))
    assert other.version != prep.version


def test_embedding_by_word_equals_that_by_entry(spark):
    docs = documents(spark).unionByName(documents(spark).where("doc_id = 12"))      # an id twice: the sum over its rows
    prep = TR.prepared(spark, docs, TR.Inputs(masked=False, buckets=997))
    table = MD.init_vocab(TR.word_entries(prep), 3)
    got = {r.doc_id: tuple(r)[1:] for r in TR.embed_by_word(prep, table, 3).collect()}
    assert not TR.is_written(spark, prep.examples_at)       # no document was joined to its n-grams
    want = {r.doc_id: tuple(r)[1:] for r in MD.embed_docs(MD.entries_of(prep.examples), table, 3).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[d], want[d], atol=1e-12) for d in want)


def test_entries_are_not_shuffled(spark):
    rows = [tuple(r) for r in documents(spark).collect()] + [
        (12, f"another, longer text of that id! {uuid.uuid4().hex}", 0), (40, None, 1), (41, "\u00e9\u00e9 \U0001f600\U0001f600 __url__ abcabcabc", 1)]
    docs = spark.createDataFrame(rows, kinds := "doc_id long, text string, label int")
    prep = TR.prepared(spark, docs, TR.Inputs(masked=False, buckets=97))        # words share buckets
    plan = TR.with_entries(prep.rows, docs, prep.how)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.index("MapInArrow") < plan.index("Join")
    got = {(r.doc_id, r.bucket): (r.n_ids, round(r.w, 9), r.occ) for r in MD.entries_of(prep.examples).collect()}
    assert not TR.is_written(spark, prep.word_ids_at)       # only those who ask for it write it
    one = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], kinds)     # one text after another, then summed by id
    want = {}
    for r in MD.doc_bucket_weights(NG.word_occurrences(one, "doc_id", "text"), NG.encode(one, "doc_id", "text", 3, 4, 97)).collect():
        n = want.setdefault((rows[r.doc_id][0], r.bucket), [0.0, 0])
        n[0] += r.w
        n[1] += r.occ
    ids = {d: sum(occ for (x, _), (_, occ) in want.items() if x == d) for d, _ in want}
    assert got == {(d, b): (ids[d], round(w, 9), occ) for (d, b), (w, occ) in want.items()}
    assert prep.examples.where("doc_id = 40").first().entries is None
    got = {r.word: (r.n_ids_w, sorted(map(tuple, r.ids))) for r in prep.word_ids.collect()}
    words = prep.words.select("word").distinct()
    per = NG.word_grams(words, 3, 4, 97).groupBy("word", "bucket").count().collect()
    assert got == {w: (sum(r["count"] for r in per if r.word == w), sorted((r.bucket, r["count"]) for r in per if r.word == w))
                   for w in {r.word for r in per}}


def test_studies_of_a_stored_model(spark):
    how = TR.Inputs(min_freq=1, buckets=997)
    cfg = MD.TrainConfig(emb_size=3, lr=0.5, epochs=2, batch_size=4)
    m = TR.trained(spark, documents(spark), cfg, how)
    assert TR.trained(spark, documents(spark), cfg, how).vocab.inputFiles() == m.vocab.inputFiles()     # not trained anew
    V = {r.bucket: np.array([r[f"e{j}"] for j in range(3)]) for r in m.vocab.collect()}
    assert set(V) == {r.bucket for r in m.prepared.mask.collect()}
    assert not np.allclose(m.dense.W, MD.init_dense(3 + len(K.NUM_COLUMNS)))
    words = {r.word: r.n_occ for r in TR.train_word_counts(m.prepared).collect()}
    diffs = MD.word_gram_diffs(TR.train_word_counts(m.prepared), MD_grams(), MD.trained_diff(m.vocab, m.dense), 997)
    rows = diffs.collect()
    bucket = {r.ngram: r.bucket for r in NG.H.with_bucket(diffs.select("ngram").distinct(), "ngram", "bucket", 997).collect()}
    want = {g: float(V[b] @ (m.dense.W[:3, 1] - m.dense.W[:3, 0])) for g, b in bucket.items()}
    assert rows and all(r["diff"] == pytest.approx(want[r.ngram]) and r.n_occ == words[r.word] for r in rows)
    table = {r.ngram: r for r in MD.gram_table_weighted(diffs, 10**6).collect()}
    for g in want:
        values = [want[g]] * sum(words[r.word] for r in rows if r.ngram == g)
        assert table[g]["mean"] == pytest.approx(want[g]) and table[g]["count"] == len(values)
        assert table[g]["std"] == pytest.approx(0, abs=1e-6)
    strength = {r.word: r.avg_strength for r in MD.word_strength_weighted(diffs, TR.train_word_counts(m.prepared), 10**6).collect()}
    assert strength.keys() == words.keys()
    for w in words:
        assert strength[w] == pytest.approx(sum(r["diff"] for r in rows if r.word == w), abs=1e-9)


def MD_grams():
    return NG.H.word_ngrams(F.col("word"), 3, 4)


def test_no_training_documents(spark):
    m = TR.trained(spark, documents(spark).where("doc_id < 0"), MD.TrainConfig(emb_size=2), TR.Inputs())
    assert m.vocab.count() == 0 and m.history.count() == 0
    pr = MD.predict(MD.inputs(m.prepared.examples, m.vocab, m.dense), m.dense)
    assert pr.count() == 0 and MD.loss_frame(pr, m.dense, 1e-4).where("n > 0").count() == 0
    assert MD.word_gram_diffs(TR.train_word_counts(m.prepared), MD_grams(), MD.trained_diff(m.vocab, m.dense), 997).count() == 0


def test_initial_vectors_are_one_expression(spark):
    buckets = spark.createDataFrame([(1,), (77,), (77,), (499999,)], "bucket long")
    got = MD.init_vocab(buckets, 50, 3)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("md5") == 2
    rows = {r.bucket: list(r)[1:] for r in got.collect()}
    for b in (1, 77, 499999):
        want = 0.1 * MD.np_std_normal([f"3:v:{b}:{j}" for j in range(50)])
        assert max(abs(x - y) for x, y in zip(rows[b], want)) < 1e-12
    assert len(rows) == 3 and got.columns == ["bucket", *[f"e{j}" for j in range(50)]]


def test_table_made_in_tasks_equals_the_expression(spark):
    buckets = spark.createDataFrame([(1,), (77,), (77,), (499999,)], "bucket long")
    want = {r.bucket: list(r)[1:] for r in MD.init_vocab(buckets, 5, 3).collect()}
    got = MD.init_table(buckets, 5, 3)
    assert got.columns == MD.init_vocab(buckets, 5, 3).columns
    rows = {r.bucket: list(r)[1:] for r in got.collect()}
    assert rows.keys() == want.keys() and all(np.allclose(rows[b], want[b], rtol=0, atol=1e-15) for b in want)


def test_examples_meet_the_table_without_a_shuffle_of_entries(spark, monkeypatch):
    docs = documents(spark).unionByName(documents(spark).where("doc_id = 12"))      # an id twice: the sum over its rows
    prep = TR.prepared(spark, docs, TR.Inputs(masked=False, buckets=997))
    table = MD.init_vocab(MD.entries_of(prep.examples).where("bucket % 3 > 0"), 4, 5)         # some buckets are unknown
    num = list(K.NUM_COLUMNS)
    dense = MD.Dense(MD.init_dense(4 + len(num), 2, 1), np.array([0.25, -0.5]), 4, num)
    want = {r.doc_id: tuple(r)[1:] for r in MD.embed_docs(MD.entries_of(prep.examples), table, 4).collect()}
    got = MD.embed_examples(prep.examples, table, 4)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.index("Aggregate") < plan.index("MapInArrow")
    got = {r.doc_id: tuple(r)[1:] for r in got.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[d], want[d], atol=1e-12) for d in want)
    monkeypatch.setattr(MD, "BROADCAST_TABLE", 0)
    joined = {r.doc_id: tuple(r)[1:] for r in MD.embed_examples(prep.examples, table, 4).collect()}
    assert joined.keys() == want.keys()
    halves = table.unionByName(table.select("bucket", *[(-F.col(f"e{k}") / 2).alias(f"e{k}") for k in range(4)]))   # rows of a bucket are summed
    for t in (table, halves):
        a, b = (sorted((r.doc_id, r.label, r.z0, r.z1, r.p0, r.p1) for r in x.collect()) for x in (
            MD.predict(MD.inputs(prep.examples, t, dense), dense), MD.predict_examples(prep.examples, t, dense)))
        assert len(a) == len(LABELS) + 2 * 2 - 1 and np.allclose(a, b, atol=1e-12)


def test_batches_of_near_ranks_are_dealt_once(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("x"))
    want = {r.doc_id: r.batch_id for r in CL.epoch_batches(df, 4, 16).collect()}
    near = CL.epoch_batches(df, 4, 16, near=16)
    assert {r.doc_id: r.batch_id for r in near.collect()} == want
    parts = near.select("batch_id", F.spark_partition_id().alias("p")).distinct().groupBy("batch_id").count().collect()
    assert sum(r["count"] for r in parts) <= 2.2 * len(parts)       # a batch is written by its own and its neighbour's task


def test_texts_are_taken_apart_once(spark, monkeypatch):
    monkeypatch.setattr(GR, "TOKENS_AT_ONCE", 3)
    rows = [(1, f"b a b, {uuid.uuid4().hex}"), (1, "b"), (2, None), (3, ""), (4, "éé \U0001f600 b b")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, label int").coalesce(1)
    prep = TR.prepared(spark, docs, TR.Inputs(masked=False, buckets=97))
    toks = docs.select("doc_id", NG.split_tokens(F.col("text")).alias("t")).where("size(t) > 0").collect()
    want = sorted((r.doc_id, len(r.t), w, r.t.count(w)) for r in toks for w in set(r.t))
    assert sorted(tuple(r) for r in prep.words.collect()) == want
    got, plain = (sorted((r.doc_id, r.n_ids, r.bucket, round(r.w, 12), r.occ) for r in MD.entries_of(x).collect()) for x in (
        prep.examples, TR.with_entries(prep.rows, docs, prep.how)))
    assert got == plain and len(got) > 0
    plan = TR.with_entries(prep.rows, prep.texts, prep.how)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan


def test_texts_meet_a_small_table_without_a_shuffle_of_words(spark, monkeypatch):
    rows = [tuple(r) for r in documents(spark).collect()] + [
        (12, f"again that id {uuid.uuid4().hex}", 0), (40, None, 1), (41, "éé \U0001f600 __url__ abcabcabc", 1), (42, "lonelywordx", 0)]
    prep = TR.prepared(spark, spark.createDataFrame(rows, "doc_id long, text string, label int"), TR.Inputs(masked=False, buckets=997))
    lone = [b for _, own in GR.word_ids(["lonelywordx"], 3, 4, 997) for b in own.tolist()]
    table = MD.init_vocab(TR.word_entries(prep).where(~F.col("bucket").isin(lone)), 3)     # some buckets are unknown
    monkeypatch.setattr(GR, "TOKENS_AT_ONCE", 5)
    got = TR.embed_by_word(prep, table, 3)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Generate" not in plan       # the count of an id's rows; no word is a row
    got = {r.doc_id: tuple(r)[1:] for r in got.collect()}
    monkeypatch.setattr(MD, "BROADCAST_TABLE", 0)
    want = {r.doc_id: tuple(r)[1:] for r in TR.embed_by_word(prep, table, 3).collect()}
    assert got.keys() == want.keys() and {12, 41} <= got.keys() and not {40, 42} & got.keys()
    assert all(np.allclose(got[d], want[d], atol=1e-12) for d in want)


@pytest.mark.parametrize("cfg", [MD.TrainConfig(emb_size=3, lr=0.3, reg_lambda=1e-3, max_grad_norm=0.05),
                                 MD.TrainConfig(emb_size=3, lr=0.1, reg_lambda=1e-2, with_features=False, per_distinct=False)])
def test_a_block_steps_through_parts_in_any_order(monkeypatch, cfg):
    rng, E, nf = np.random.default_rng(5), 3, 2 if cfg.with_features else 0
    docs = []       # batch, id, label, n_ids, z, buckets, w, occ; an id twice, a label that is no class, texts without ids
    for i in range(15):
        b = np.sort(rng.choice(np.arange(1, 90), rng.integers(0, 12), replace=False))
        docs.append((i // 5, str(i - (i == 7)), -1 if i == 3 else int(rng.integers(2)), float(max(len(b), 1)), rng.normal(size=nf), b,
                     rng.random(len(b)), rng.integers(1, 4, len(b))))
    V = {b: rng.normal(size=E) for b in range(1, 80)}       # the others are unknown
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.float64(), *[pa.list_(x) for x in (pa.float64(), pa.int32(), pa.float64(), pa.int32())]]
    names = ["batch_id", "id", "label", "n_ids", "z", "bucket", "w", "occ"]
    got = pa.record_batch([pa.array([x[k] for x in docs], t) for k, t in enumerate(kinds)], names)
    got = got.append_column("keep", pa.array([[]] * len(docs), pa.list_(pa.float64())))
    monkeypatch.setattr(MD, "PART_ENTRIES", 9)
    monkeypatch.setattr(MD, "VECTORS_AT_ONCE", 7)
    parts = list(MD.packed_parts([got]))
    assert len(parts) > 3
    keys = np.array(list(V), np.int32)
    table = [pa.record_batch([pa.array([v], t) for v, t in zip(
        [-1 if c == "batch_id" else keys[a:a + 30].tobytes() if c == "bucket" else
         np.stack([V[b] for b in keys[a:a + 30]]).tobytes() if c == "w" else None for c in MD.PACKED], parts[0].schema.types)],
        list(MD.PACKED)) for a in range(0, len(keys), 30)]
    want = {i: (sum(len(x[5]) for x in docs if x[0] == i), 5) for i in range(3)}
    W0 = MD.init_dense(E + nf, 2, 1, cfg.with_features)

    def run(rows):
        steps = MD.BlockSteps(W0, np.zeros(2), E, cfg, len(V), want)
        out = [r for b in steps(iter(rows)) for r in b.to_pylist()]
        vectors = {b: v for r in out if r["kind"] == 0 for b, v in zip(
            np.frombuffer(r["bucket"], np.int32).tolist(), np.frombuffer(r["w"]).reshape(-1, E))}
        return vectors, steps.W, steps.b, [np.frombuffer(r["w"])[0] for r in out if r["kind"] == 2]
    W, bias, losses, vec = W0, np.zeros(2), [], {b: V.get(b, np.zeros(E)) for b in {*V, *(int(x) for d in docs for x in d[5])}}
    for i in range(3):
        batch = [x for x in docs if x[0] == i]
        alike = [[y for y in batch if y[1] == x[1]] for x in batch]       # rows of an id share its entries
        X = np.array([np.r_[sum((w * vec[b] for y in same for b, w in zip(y[5], y[6])), np.zeros(E)), x[4]] for x, same in zip(batch, alike)])
        z, Y = X @ W + bias, np.array([[x[2] == c for c in (0, 1)] for x in batch])
        P = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        scale = 1 / len(batch) if cfg.with_features else 1
        reg = np.abs(W).sum() if cfg.with_features else 0.5 * (W ** 2).sum()
        losses.append(-np.log([p[1 if x[2] == 1 else 0] for p, x in zip(P, batch)]).mean() + cfg.reg_lambda * reg)
        G = P - Y
        W, bias = MD.updated(W, bias, scale * X.T @ G, scale * G.sum(0), cfg)
        for x, same in zip(batch, alike):
            g = sum(G[k] for k, y in enumerate(batch) if y[1] == x[1])
            for b, occ in zip(x[5], x[7]):
                vec[b] = vec[b] - cfg.lr * scale * (1 if cfg.per_distinct else occ) / x[3] * (W[:E] @ g)
    for rows in ([*table, *parts], [*parts[::-1], *table], [table[0], *parts[2:], *table[1:], *parts[:2]]):
        vectors, w, b, told = run(rows)
        assert np.allclose(w, W, atol=1e-12) and np.allclose(b, bias, atol=1e-12) and np.allclose(told, losses, atol=1e-12)
        assert vectors.keys() == vec.keys() and all(np.allclose(vectors[k], vec[k], atol=1e-12) for k in vec)
    with pytest.raises(ValueError, match="not whole"):
        run([*table, *parts[1:]])


def test_training_and_predictions_take_entries_as_bytes(spark):
    how, cfg = TR.Inputs(min_freq=1, buckets=499), MD.TrainConfig(emb_size=3, epochs=1, batch_size=4)
    m = TR.trained(spark, documents(spark), cfg, how)
    assert [m.prepared.packed.schema[c].dataType.simpleString() for c in MD.ENTRY] == ["binary"] * 3
    plan = MD.predict_examples(m.prepared.packed, m.vocab, m.dense)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "entries" not in plan       # no entry is a row, none is joined to the table
    a, b = (sorted((r.doc_id, round(r.p0, 12), round(r.p1, 12)) for r in x.collect()) for x in (
        MD.predict_examples(m.prepared.packed, m.vocab, m.dense), MD.predict_examples(m.prepared.examples, m.vocab, m.dense)))
    assert a == b and len(a) == len(LABELS)
    want = {r.doc_id: tuple(r) for r in MD.embed_examples(m.prepared.examples, m.vocab, 3).collect()}
    assert {r.doc_id: tuple(r) for r in MD.embed_examples(m.prepared.packed, m.vocab, 3).collect()} == want and want
