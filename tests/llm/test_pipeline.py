"""The pipeline's stages, each held against brute force on its own input."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer

SF = "/root/testdata/sf0.001"


def plain_verdicts(spark, docs, came):
    """Ids that the quality stage keeps: base rules by hand, labels by a plain Viterbi, a text at a time."""
    from test_operators import base_counts

    from lectern.llm import quality_crf

    model = quality_crf.train(spark, docs, spark.read.parquet(f"{SF}/labels.parquet"))
    for d, t in came:
        n, _, _, _, repeated = base_counts(t)
        if n < 10 or 100 * repeated > 20 * n:
            continue
        _, feats, chars, _ = quality_crf.read_block([t])
        score, paths = feats @ model.weights, None
        for x in score:
            add = (0.0, x)
            if paths is None:
                paths = [(model.start[b] + add[b], [b]) for b in (0, 1)]
            else:
                paths = [max(((p + model.steps[y[-1], b] + add[b], [*y, b]) for p, y in paths), key=lambda v: (v[0], -v[1][-2])) for b in (0, 1)]
        labels = np.array(paths[0][1] if paths[0][0] >= paths[1][0] else paths[1][1])
        if (chars * (labels == 0)).sum() / chars.sum() >= model.share:
            yield d


def scored(spark, texts):
    """Ids of the texts with a passage that some item scores in, all passages held against all items."""
    from lectern.llm import decontaminate

    rows = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    ix = decontaminate.Index(rows)
    out = set()
    for d, t in texts.items():
        w = decontaminate.words(t)
        for at in range(0, len(w), ix.longest):
            have = {ix.terms.get(x) for x in w[at : at + 2 * ix.longest]}
            if any(sum(s for x, s in it.weights.items() if x in have) >= ix.threshold for it in ix.items):
                out.add(d)
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows, no rows, and columns with names that the stages use."""
    os.environ.setdefault("PYTHONHASHSEED", "0")
    import corpus_pipeline

    good = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars between 1500 and 3000").orderBy("doc_id").limit(3).collect()
    texts = [r["text"] for r in good]
    long = "\n".join(" ".join(f"w{i}x{k}" for k in range(12)) + "." for i in range(4000))
    odd = [(1, texts[0]), (1, texts[0]), (2, texts[0]), (3, ""), (4, None), (5, long), (None, texts[1]), (None, None), (6, " \n\t"), (7, texts[2])]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, n string, alike string, keep string, chunk int"
    df = spark.createDataFrame([(d, t, None, None, None, "n", "a", "k", 1) for d, t in odd], schema)
    stages = dict(corpus_pipeline.STAGES)

    def ids(name, rows=df):
        out = stages[name](spark, rows, SF)
        if name != "pack":
            assert out.columns == rows.columns
        return sorted((r["doc_id"] for r in out.collect()), key=repr)

    same = lambda *x: sorted(x, key=repr)
    kept = ids("quality_rules")
    assert not {3, 4, 6} & set(kept)  # no words: rejected
    assert ids("near_dedup") == same(1, 3, 4, 5, 7, None, None)  # 6 is a copy of 3, which has no words either; null texts and ids stay
    # 2 and the second row of 1 are copies and lose their texts; no_text rows have nothing to lose.
    assert ids("repeat_dedup") == same(1, 3, 4, 5, 6, 7, None, None)
    assert ids("decontamination") == same(*[d for d, _ in odd])
    assert set(ids("pack")) == {d for d, _ in odd}
    for name in stages:
        assert ids(name, df.limit(0)) == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark, tmp_path):
    os.environ.setdefault("PYTHONHASHSEED", "0")
    import corpus_pipeline
    from test_operators import brute_removed, jaccard_classes

    from lectern.llm.words import words

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps, first = docs.columns, {}, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        steps[name] = ([(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()], docs)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    came, df = steps["quality_rules"]
    assert sorted(r["doc_id"] for r in df.collect()) == sorted(plain_verdicts(spark, first, came))
    came, df = steps["near_dedup"]
    assert sorted(r["doc_id"] for r in df.collect()) == sorted({c for _, c, _ in jaccard_classes(came)})
    came, df = steps["repeat_dedup"]
    left = {r["doc_id"]: r for r in df.collect()}
    for d, n, removed, _, _ in brute_removed(came):
        assert removed == n or d in left
        if d in left:
            assert n - removed - 6 * removed <= len(left[d]["text"].encode()) <= n - removed
            assert left[d]["n_chars"] == len(left[d]["text"])
    came, df = steps["decontamination"]
    items = [b" ".join(words(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = {d for d, t in came if any(i in b" ".join(words(t)) for i in items)}
    left = {r["doc_id"] for r in df.collect()}
    assert not holds & left
    dropped = {d: t for d, t in came if d not in left}
    assert set(dropped) == scored(spark, dropped)  # clean documents stay
    came, df = steps["pack"]
    assert {r["doc_id"] for r in df.select("doc_id").distinct().collect()} == {d for d, _ in came}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for d, t in came}
    for r in df.collect():
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]
    assert df.agg({"length": "sum"}).first()[0] == sum(map(len, ids.values()))
    loads = [r["n"] for r in df.groupBy("sequence_id").sum("length").withColumnRenamed("sum(length)", "n").collect()]
    assert max(loads) <= 1024 and len(loads) <= -(-sum(loads) // 1024) * 1.02 + 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_registered():
    import __spark_entry__ as registry

    names = set(registry.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert any(x.startswith(f"op{n}_") for x in names)
