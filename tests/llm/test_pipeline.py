import hashlib
import random

from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_near_dups import brute as near
from tests.llm.test_toxicity import corpus
from watchline.llm import toxicity
from watchline.llm.queries import VOCABULARY


def test_stages_against_brute_force(spark, tmp_path):
    docs, labels = corpus(400, seed=8)
    rng = random.Random(1)
    items = [(i, " ".join(rng.choices(["bench", "mark", "item", "word", "re"], k=12))) for i in range(3)]
    rows = [(i, t) for i, t, _ in docs] + [(1000 + i, docs[i][1] + " tail") for i in range(40)]
    rows += [(2000, "some words " + items[0][1] + " more"), (2001, 'x token = "' + "ab" * 20 + '" y'), (2002, None), (2003, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    # Scores have their own tests; from the rejected ids on, every stage is recomputed in plain Python.
    scores = toxicity.toxicity(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    toxic = {r.doc_id for r in scores if r.predicted}
    assert len(toxic) > 50
    left = [(i, t) for i, t in rows if i not in toxic]
    left = [(i, t) for i, t in left if {r[0]: r[3] for r in near(left)}[i]]
    left = [(i, t) for i, t in left if not {r[0]: r[5] for r in contaminated(left, items)}[i]]
    left = [(i, t if i != 2001 else 'x [SECRET]" y') for i, t in left]
    assert 2000 not in dict(left) and set(got) == set(dict(left)) and len(left) < len(rows) - 90
    theirs = Tokenizer.from_file(VOCABULARY)
    for i, t in left:
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
