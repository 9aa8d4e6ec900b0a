import hashlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import plain
from feedloom.llm import bpe, mixing, toxicity
from feedloom.llm.common import shared_folder, table
from test_texts import oracle
from feedloom.llm.queries import ORACLES


def plain_run(spark, sf_dir):
    """The stages by plain Python and SQL, on the learned scores."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
    rows = [(r.doc_id, r.text, r.source) for r in scored if r.score < 0.5]
    texts = plain.line_dedup([(i, t) for i, t, _ in rows])
    keep = {i for (i, _, _), c in zip(rows, plain.similar([(i, texts[i]) for i, _, _ in rows])) if i == c}
    rows = [(i, texts[i], s) for i, _, s in rows if i in keep]
    taken = {r[0]: (r[1], r[4]) for r in oracle(rows, ["doc_id", "text", "source"], ORACLES["op8_mix_sources"])}
    library = Tokenizer.from_file(bpe.installed())
    out = Counter()
    for i, text, source in rows:
        size, words = taken[i]
        ids = library.encode(text or "", add_special_tokens=False).ids
        times = words // size if size else 0
        if size:
            out[(i, source, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                 hashlib.sha256((text or "").encode()).hexdigest())] += times
    return +out


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_run_as_plain(spark, sf_dir):
    got = Counter((r.doc_id, r.source, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect() if r.n_tokens)
    assert got == plain_run(spark, sf_dir)


def test_stages_keep_columns_and_cases(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "src0", 0), (9002, "", "en", "src0", 0), (None, "x y", "en", None, 3)], docs.schema)
    some = docs.limit(40).union(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        some = spark.createDataFrame(stage(spark, some, sf_dir).collect(), docs.schema)
        assert some.columns == docs.columns, name
        assert spark.createDataFrame(stage(spark, docs.limit(0), sf_dir).collect(), docs.schema).isEmpty(), name
    assert corpus_pipeline.STAGES[-1][1](spark, some, sf_dir).count() == some.count()
    assert mixing.MOST == 3


def test_a_cluster_must_name_its_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()
        class sparkContext:  # noqa: N801
            master = "spark://cluster:7077"

    with pytest.raises(ValueError):
        shared_folder(Session())
