import math

import numpy as np
from pyspark.sql import functions as F

from pagesieve.operators import model as MD
from pagesieve.operators import ngrams as NG


def test_one_training_step_equals_numpy(spark):
    texts = ["good solid reporting here", "cheap pills buy now now", "a careful long analysis",
             "click here for free money", "", "balanced view of events"]
    labels = [0, 1, 0, 1, 1, 0]
    docs = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(zip(texts, labels))],
                                 "doc_id long, text string, label int")
    occ = NG.word_occurrences(docs, "doc_id", "text")
    enc = NG.encode(docs, "doc_id", "text", 3, 4, 1000)
    wts = MD.doc_bucket_weights(occ, enc)
    z = docs.select("doc_id", (F.length("text") / 10.0 - 2.0).alias("z_f"))
    lab = docs.select("doc_id", "label")
    E = 3
    cfg = MD.TrainConfig(emb_size=E, lr=0.1, reg_lambda=1e-3, max_grad_norm=0.05, epochs=1, batch_size=None)
    vocab, dense, _ = MD.train(wts, z, lab, cfg, ["f"])

    # numpy reference of one step
    occ_l = occ.collect()
    enc_l = enc.collect()
    words = {}
    for r in occ_l:
        words.setdefault(r.doc_id, {})[r.word_pos] = []
    for r in enc_l:
        words[r.doc_id][r.word_pos].append(r.bucket)
    buckets = sorted({r.bucket for r in enc_l})
    V = {b: 0.1 * MD.np_std_normal([f"0:v:{b}:{j}" for j in range(E)]) for b in buckets}
    W = MD.init_dense(E + 1, 2, 0, True)
    b0 = np.zeros(2)
    X, Y, ids = [], [], []
    zf = {r.doc_id: r.z_f for r in z.collect()}
    for d in range(len(texts)):
        ws = [words.get(d, {})[k] for k in sorted(words.get(d, {}))]
        emb = np.mean([np.mean([V[i] for i in w], axis=0) if w else np.zeros(E) for w in ws], axis=0) \
            if ws else np.zeros(E)
        X.append(np.concatenate([emb, [zf[d]]]))
        Y.append(labels[d])
        ids.append([i for w in ws for i in w])
    X = np.array(X)
    lin = X @ W + b0
    P = np.exp(lin - lin.max(axis=1, keepdims=True))
    P /= P.sum(axis=1, keepdims=True)
    G = (P - np.eye(2)[Y]) / len(Y)
    dW = X.T @ G + cfg.reg_lambda * np.sign(W)
    gn = np.linalg.norm(dW)
    if gn > cfg.max_grad_norm:
        dW *= cfg.max_grad_norm / gn
    W2 = W - cfg.lr * dW
    b2 = b0 - cfg.lr * G.sum(axis=0)
    DX = G @ W2.T
    for d in range(len(texts)):
        if ids[d]:
            share = cfg.lr * DX[d, :E] / len(ids[d])
            for i in set(ids[d]):
                V[i] = V[i] - share
    assert np.allclose(dense.W, W2, atol=1e-9) and np.allclose(dense.b, b2, atol=1e-9)
    got = {r.bucket: np.array([r[f"e{j}"] for j in range(E)]) for r in vocab.collect()}
    for i in buckets:
        assert np.allclose(got[i], V[i], atol=1e-9), i


def test_stream_equals_batch(spark):
    from pagesieve.plans.q_stream import w01_batch_twin, w01_stream_link_scores
    sf = "/root/testdata/sf0.001"
    a = sorted(tuple(r) for r in w01_stream_link_scores(spark, sf).collect())
    b = sorted(tuple(r) for r in w01_batch_twin(spark, sf).collect())
    assert a == b and len(a) > 0


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "host" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())
    assert not math.isnan(rows[0].avg_p_slop)
