"""The registered queries against their SQL or a brute-force version, over whole small tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from rows_equal import same_rows
from stratacloud.llm.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def documents(small):
    import pandas as pd

    return pd.read_parquet(f"{small}/documents.parquet").sort_values("doc_id")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, small, name):
    same_rows(QUERIES[name](spark, small).toPandas(), duck.sql(ORACLE_SQL[name]).df())


def test_op1_scores(spark, small, documents):
    got = QUERIES["op1_lm"](spark, small).toPandas().set_index("doc_id")
    words = {i: [*(t or "").encode().lower().split(), b" "] for i, t in zip(documents.doc_id, documents.text)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    count = collections.Counter(w for i in words if not held[i] for w in words[i])
    n, v = sum(count.values()), len(count)
    for i, w in words.items():
        r = got.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(count[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    out = got[got.held_out]
    assert (got.score < 0).all() and out.score.sum() > out.base_score.sum()
    again = QUERIES["op1_lm"](spark, small).toPandas().set_index("doc_id")
    assert (again.score.loc[got.index] == got.score).all()


def test_op3_removes_what_brute_force_removes(spark, small, documents):
    got = QUERIES["op3_suffix"](spark, small).toPandas().set_index("doc_id")
    seen, removed = set(), 0
    for i, text in zip(documents.doc_id, documents.text):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 2, bool)
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                gone[s + 1 : s + 101] = True
            seen.add(w)
        gone = gone[1:-1] if len(raw) else gone[:0]
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        r = got.loc[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())
        removed += len(raw) - len(kept)
    assert removed > 0


def test_op4_equals_the_library(spark, small, documents):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    got = QUERIES["op4_sentencepiece"](spark, small).toPandas().set_index("doc_id")
    assert got.round_trip.all()
    for i, text in zip(documents.doc_id, documents.text):
        ids = sp.encode(text or "")
        assert got.loc[i].n_pieces == len(ids) and list(got.loc[i].ids) == ids
        assert got.loc[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_op5_held_out_accuracy(spark, small, documents):
    got = QUERIES["op5_langid"](spark, small).toPandas().merge(documents[["doc_id", "lang"]])
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]
    assert got.score.between(0, 1).all()
    out = got[got.held_out & (got.lang_pred != "und")]
    assert (out.lang_pred == out.lang).mean() > 0.95


def test_op7_base_spans(spark):
    import pandas as pd

    small = "/root/testdata/sf0.01"  # the smallest tables hold no secrets
    documents = pd.read_parquet(f"{small}/documents.parquet")
    assign = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    got = QUERIES["op7_secrets"](spark, small).toPandas().set_index("doc_id")
    found = 0
    for i, text in zip(documents.doc_id, documents.text):
        text = text or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
        r = got.loc[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == k for x in spans) for k in range(3)]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
        found += len(spans)
    assert found > 0


def test_op10_agrees_with_labels(spark, small):
    import pandas as pd

    got = QUERIES["op10_quality"](spark, small).toPandas().merge(pd.read_parquet(f"{small}/labels.parquet"))
    assert (got.accepted == (got.quality == 1)).mean() > 0.95
    assert (got[got.quality == 1].accepted).mean() > 0.97


def test_pipeline(spark, small, documents):
    """Every stage against a plain version of it, over the rows that the stage before has kept."""
    import duckdb
    import pandas as pd
    import sentencepiece

    import corpus_pipeline
    from stratacloud.llm import secret_scan

    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept[-1], small)
        if k < 4:
            assert out.columns == docs.columns
            kept.append(out.cache())
    final = out.toPandas()
    frames = [f.toPandas() for f in kept]

    def sql(text, frame):
        c = duckdb.connect()
        c.register("documents", frame)
        return c.sql(text).df()

    accepted = QUERIES["op10_quality"](spark, small).filter("accepted").toPandas().doc_id
    assert sorted(frames[1].doc_id) == sorted(accepted)
    labels = pd.read_parquet(f"{small}/labels.parquet").merge(frames[0][["doc_id"]])
    clean = labels[(labels.quality == 1) & (labels.toxic == 0)].doc_id
    assert clean.isin(frames[1].doc_id).mean() > 0.97
    groups = sql(ORACLE_SQL["op9_minhash"], frames[1])
    assert sorted(frames[2].doc_id) == sorted(groups[groups.kept].doc_id)
    control = secret_scan.fit(kept[2])
    before = dict(zip(frames[2].doc_id, frames[2].text))
    assert {i: secret_scan.redact(t, control) for i, t in before.items()} == dict(zip(frames[3].doc_id, frames[3].text))
    assert not any(secret_scan.base_spans(t) for t in frames[3].text)
    mixed = sql(ORACLE_SQL["op2_mixing"], frames[3])
    assert collections.Counter(frames[4].doc_id) == +collections.Counter(dict(zip(mixed.doc_id, mixed.copies)))
    sp = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    assert collections.Counter(zip(final.doc_id, final.decoded)) == collections.Counter(zip(frames[4].doc_id, frames[4].text)) and len(final) > 0
    assert all(list(r.ids) == sp.encode(r.decoded) for r in final.itertuples())
    assert corpus_pipeline.run(spark, small).count() == len(final)
