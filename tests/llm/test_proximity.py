import numpy as np
import pytest

from pathweave.llm import decontam


@pytest.mark.parametrize("query", ["a c", "C, a b", "d", "a a b", "b zz", "..."])
def test_proximity_over_the_whole_index(spark, query):
    rng = np.random.default_rng(11)
    docs = [(i, " ".join(rng.choice(list("abcdefgh"), rng.integers(0, 25)))) for i in range(80)] + [(None, "a b c"), (90, None)]
    index = decontam.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    wanted = [w for w in query.lower().replace(",", "").split() if w != "..."]
    want = []
    for d, t in docs:
        x = (t or "").split()
        at = [i for i, w in enumerate(x) if wanted and w == wanted[0] and all(v in x[max(0, i - 3) : i + 4] for v in wanted)]
        want += [(d, at)] if at else []
    got = [(r.doc_id, list(r.positions)) for r in decontam.proximity(index, query, 3).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and index.count() > 1
