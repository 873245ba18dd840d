import hashlib
import zlib

import oracle
import pytest

from lodestrata.llm import merkle

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, s int, block string, leaf int, part int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = [row[0], row[2], row[3], row[4], text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def siblings(tree, at, fanout):
    out = []
    for level in tree[:-1]:
        run = at // fanout * fanout
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + fanout])))
        at //= fanout
    return out


def brute(rows, fanout):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        trees[s] = levels([leaf_of(r, r[1]) for r in by[s]], fanout)
    top = levels([trees[s][-1][0] for s in order], fanout)
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            steps = siblings(trees[s], i, fanout) + siblings(top, k, fanout)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            text = None if r[1] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if bad else r[1]
            got = leaf_of(r, text)
            for b, z in steps:
                got = h(b, got, z)
            out.append((r[0], leaf_of(r, r[1]), trees[s][-1][0], top[-1][0], h(*[b + z for b, z in steps]), got, got == top[-1][0]))
    return sorted(out, key=repr)


def run(spark, rows, monkeypatch, tmp_path, fanout):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(path)
    with monkeypatch.context() as m:
        m.setattr(merkle.manifest, "__defaults__", (fanout,))
        m.setattr(merkle.proofs, "__defaults__", (fanout,))
        return sorted((tuple(r) for r in merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)


def test_matches_sql(spark):
    assert oracle.same(merkle.op13_merkle_manifest(spark, D), D, merkle.OP13_SQL) == 200


@pytest.mark.parametrize("fanout", [2, 3])
def test_matches_brute_force(spark, monkeypatch, tmp_path, fanout):
    """Sources of 1, 2, 5, 17 and 90 rows with a fan-out of 2 or 3: many rounds, unequal trees, a source of one leaf, more sources than the fan-out."""
    sizes = {"b": 90, "a": 17, None: 5, "é": 1, "zz": 2, "": 4, "B": 3}
    rows, n = [], 0
    for s, k in sizes.items():
        for _ in range(k):
            rows.append((n * 3, f"Text {n} With É and A", s, None if n % 4 == 0 else "en", n, 1, "x", 2, 3))
            n += 1
    rows += [rows[3]] * 6 + [(None, "No Id", "a", "en", 1, 1, "x", 2, 3), (7, None, "b", None, None, 1, "x", 2, 3), (8, "", "b", "en", 0, 1, "x", 2, 3), (10**12, "Long " * 50_000, "b", "en", 5, 1, "x", 2, 3)]
    assert run(spark, rows, monkeypatch, tmp_path, fanout) == brute(rows, fanout)


def test_tampering_is_found_and_small_tables(spark, monkeypatch, tmp_path):
    rows = [(i, "Upper" if i % 2 else "lower", "s", "en", 1, 1, "x", 2, 3) for i in range(40)]
    got = run(spark, rows, monkeypatch, tmp_path, 16)
    assert got == brute(rows, 16)
    assert [r[0] for r in sorted(got) if not r[6]] == [i for i in range(40) if i % 2 and zlib.crc32(str(i).encode()) % 5 == 0] != []
    one = rows[:1]
    assert run(spark, one, monkeypatch, tmp_path / "one", 16) == brute(one, 16)
    assert run(spark, [], monkeypatch, tmp_path / "none", 16) == []
