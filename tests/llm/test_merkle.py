"""Merkle manifest against a plain recomputation."""
import hashlib
import zlib

import numpy as np
import pytest

from shroud.llm import merkle


def H(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def leaf(row, lower=False):
    out = ""
    for c in merkle.FIELDS:
        v = row[c]
        if v is not None and c == "text" and lower:
            v = "".join(x.lower() if "A" <= x <= "Z" else x for x in v)
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(out)


def climb(nodes, at):
    """Siblings of a node level by level, and the root."""
    path = []
    while len(nodes) > 1:
        low = at // 16 * 16
        run = nodes[low:low + 16]
        path.append(("".join(run[:at - low]), "".join(run[at - low + 1:])))
        nodes, at = [H("".join(nodes[k:k + 16])) for k in range(0, len(nodes), 16)], at // 16
    return path, nodes[0]


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    order = {s: sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for s in names}
    digests = {s: [leaf(r) for r in order[s]] for s in names}
    subroots = [climb(digests[s], 0)[1] for s in names]
    out = []
    for k, s in enumerate(names):
        up, root = climb(subroots, k)
        for i, r in enumerate(order[s]):
            path = climb(digests[s], i)[0] + up
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            f = leaf(r, lower=bad)
            for a, b in path:
                f = H(a + f + b)
            out.append((r["doc_id"], digests[s][i], subroots[k], root, H("".join(a + b for a, b in path)), f, f == root))
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def check(df):
    rows = [r.asDict() for r in df.collect()]
    got = [tuple(r[c] for c in COLUMNS) for r in merkle.manifest(df).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)
    return got


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_layout_is_a_recursive_split(levels):
    every = [merkle.address(levels, d, np.arange(16 ** d)) for d in range(levels)]
    assert sorted(np.concatenate(every).tolist()) == list(range(merkle.nodes(levels)))
    if levels > 1:                                               # the top half, then each lower subtree in one piece
        top = levels // 2
        assert {x for d in range(top) for x in every[d].tolist()} == set(range(merkle.nodes(top)))
        size = merkle.nodes(levels - top)
        for j in (0, 16 ** top - 1):
            mine = {int(x) for d in range(top, levels) for x in every[d][j * 16 ** (d - top):(j + 1) * 16 ** (d - top)]}
            assert mine == set(range(merkle.nodes(top) + j * size, merkle.nodes(top) + (j + 1) * size))


def test_edges(spark):
    schema = "doc_id long, source string, lang string, n_chars int, text string, tree string, rank int, root string"
    rows = [(1, "a", "en", 3, "ABC"), (1, "a", "en", 3, "ABC"), (1, "a", "en", 3, "abc"), (2, None, None, None, None), (None, None, "de", 0, ""), (None, "", "de", 0, "X"), (3, "", "x", 1, "É" * 9999),
            (5, "É", "en", 1, "Abc"), (9, "=", "en", 1, "-"), *((k, "b", "en", k, f"Text {k}") for k in range(300))]
    check(spark.createDataFrame([(*r, "t", 0, "r") for r in rows], schema))
    assert merkle.manifest(spark.createDataFrame([], schema)).count() == 0
    one = check(spark.createDataFrame([(7, "s", "en", 1, "x", "", 0, "")], schema))
    assert one[0][1] == one[0][2] == one[0][3]


def test_several_blocks_and_many_sources(spark):
    """More rows in a source than a block has entries, more sources than a run."""
    df = spark.range(9000).selectExpr("id AS doc_id", "CASE WHEN id < 8200 THEN 'hot' ELSE concat('s', id % 70) END AS source", "'en' AS lang", "CAST(id % 7 AS INT) AS n_chars", "concat('Doc ', id) AS text")
    got = check(df)
    assert 0 < sum(not r[-1] for r in got) < len(got)
