"""Codes against a plain Lloyd search in Python's whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from pathweave.llm import queries, vector_codes


def brute(rows, parts=16, entries=64, rounds=2):
    """rows (id, vector): (codes with errors, codebooks)."""
    fine = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    cut = [(i, [[math.floor(256 * x) for x in v[s * len(v) // parts : (s + 1) * len(v) // parts]] for s in range(parts)]) for i, v in fine]
    first = sorted(fine, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[[math.floor(256 * x) for x in v[s * len(v) // parts : (s + 1) * len(v) // parts]] for _, v in first] for s in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, book: min((square(p, e), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for s in range(parts):
            groups = {}
            for _, p in cut:
                groups.setdefault(nearest(p[s], books[s])[1], []).append(p[s])
            books[s] = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else e for j, e in enumerate(books[s])]
    out = []
    for i, p in cut:
        near = [nearest(p[s], books[s]) for s in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in near), sum(d for d, _ in near)))
    return sorted(out, key=str), books


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, None) for i, v in rows], f"vec_id long, embedding array<{kind}>, code string")


def check(spark, rows, kind="float"):
    made = vector_codes.compress(frame(spark, rows, kind), keep=("code",))
    want, books = brute(rows)
    assert made.books == books
    assert sorted([(r.vec_id, r[made.code], r[made.error]) for r in made.rows.collect()], key=str) == want
    return made


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_equals_plain_search(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (9, 32))
    v = (centres[rng.integers(9, size=400)] + rng.normal(0, 0.05, (400, 32))).astype(np.float32)
    if seed == 2:  # few different components: many ties
        v = np.round(v * 8) / 8
    rows = [(int(i), x.tolist()) for i, x in zip(rng.permutation(400), v, strict=True)]
    rows += [(500, None), (501, [None] * 32), (502, [float("nan")] * 32), (503, [float("inf")] * 32), (3, rows[0][1]), (None, rows[1][1]), rows[2], rows[2]]
    made = check(spark, rows)
    assert made.code == "code_" and made.sha256() == hashlib.sha256(",".join(str(x) for b in made.books for e in b for x in e).encode()).hexdigest()


def test_few_rows_doubles_and_large_numbers(spark):
    check(spark, [(2, [0.5] * 16), (1, [-0.001] * 16)], "double")
    rng = np.random.default_rng(5)
    check(spark, [(i, x.tolist()) for i, x in enumerate(rng.normal(0, 1e6, (90, 32)))], "double")  # beyond exact doubles
    with pytest.raises(Exception, match="cannot be coded"):
        vector_codes.compress(frame(spark, [(1, [2.0**41] * 16), (2, [0.0] * 16)], "double")).rows.collect()


def test_vectors_that_cannot_be_cut_and_empty_tables(spark):
    rows = [(1, [0.1] * 16), (2, [0.2] * 17), (3, []), (4, [0.3] * 32), (5, [0.4] * 16)]
    made = vector_codes.compress(frame(spark, rows))
    assert sorted(r.vec_id for r in made.rows.collect()) == [1, 5]
    for none in ([], [(1, None)]):
        made = vector_codes.compress(frame(spark, none))
        assert made.rows.collect() == [] and made.books == [] and made.rows.columns == ["vec_id", "code", "error"]


def test_long_vectors(spark):
    rng = np.random.default_rng(6)
    check(spark, [(i, x.tolist()) for i, x in enumerate(rng.normal(0, 1, (70, 16 * 300)).astype(np.float32))])


def test_bounds_prune_and_never_change_a_code():
    rng = np.random.default_rng(7)
    x = np.floor(rng.normal(0, 40, (3000, 2, 4)) + 200 * rng.integers(0, 4, (3000, 2, 1)))
    before = vector_codes.Books(x[:64].transpose(1, 0, 2).astype(int).tolist())
    state, _ = vector_codes.first_pass(x, before)
    moved = [[[c + int(rng.integers(-2, 3)) for c in e] for e in b] for b in before.entries]
    after = vector_codes.Books(moved, before)
    state, best, looked = vector_codes.next_pass(x, after, state)
    plain, want = vector_codes.first_pass(x, after)
    assert (state.own == plain.own).all() and (best == want).all()
    assert looked < 0.5 * x.shape[0] * 2 * 64
    true = np.stack([np.sqrt(((x[:, s, None] - np.array(moved[s], float)) ** 2).sum(-1)) for s in range(2)], 1)
    assert (state.lower <= true).all() and (state.upper >= np.take_along_axis(true, state.own[..., None], 2)[..., 0]).all()


def test_query(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, 0.1, 16).astype(np.float32).tolist(), [None, 1, 2][i % 3]) for i in range(120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_vector_codes(spark, str(tmp_path)).collect()
    want, books = brute([(i, v) for i, v, _ in rows])
    assert sorted([(r.vec_id, r.code, r.error) for r in got], key=str) == want
    errors = {}
    for i, _, e in want:
        errors[rows[i][2]] = errors.get(rows[i][2], 0) + e
    assert all(r.label_error == errors[rows[r.vec_id][2]] for r in got)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()}
