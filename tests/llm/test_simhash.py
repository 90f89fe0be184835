import re

import numpy as np
import xxhash

from heatgraph.llm import simhash


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """rows: (id, text); smallest id reachable over links of at most 4 bits."""
    prints = [plain_fingerprint(t or "") for _, t in rows]
    label = {i: r[0] for i, r in enumerate(rows)}
    changed = True
    while changed:
        changed = False
        for i, p in enumerate(prints):
            low = min(label[j] for j, q in enumerate(prints) if (p ^ q).bit_count() <= 4)
            if low < label[i]:
                label[i], changed = low, True
    return {rows[i][0]: (prints[i], label[i]) for i in label}


def test_golay_index_shared_within_two_bits():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000, dtype=np.uint32)
    own = simhash.golay_indices(words)
    for flips in (1, 2):
        other = words.copy()
        for i in range(len(other)):
            for b in rng.choice(23, flips, replace=False):
                other[i] ^= 1 << int(b)
        near = simhash.golay_indices(other)
        assert all(set(a) & set(b) for a, b in zip(own, near))
        if flips == 1:
            assert all(a[0] in set(b) and b[0] in set(a) for a, b in zip(own, near))


def test_every_pair_within_four_bits_meets_under_a_key():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 64, 1500, dtype=np.uint64)
    other = base.copy()
    for i in range(len(other)):
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            other[i] ^= np.uint64(1 << int(b))

    def keyed(prints):
        row, key, anchor = simhash.golay_keys(prints)
        out = [{} for _ in prints]
        for r, k, a in zip(row.tolist(), key.tolist(), anchor.tolist()):
            out[r][k] = a
        return out

    for a, b in zip(keyed(base), keyed(other)):
        assert any(a[k] or b[k] for k in a.keys() & b.keys())


def test_fingerprint_matches_plain_form():
    for text in ("", "  \t", "One", "A b C", "a b c d", "É x  y z w é", "x " * 50, "The the THE of to a b c d e f g"):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_links_connect_like_all_pairs(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    prints = set(int(s) for s in seeds)
    for s in seeds[:4]:  # dense clusters, which make keys of many rows
        for _ in range(60):
            x = int(s)
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(b)
            prints.add(x)
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    frame = spark.createDataFrame(signed, "fp bigint").repartition(3)
    got = {(r.u, r.v) for r in simhash.fingerprint_links(frame).collect()}
    assert all(((u ^ v) & (2**64 - 1)).bit_count() <= 4 for u, v in got)

    def roots(pairs):
        parent = {p[0]: p[0] for p in signed}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for u, v in pairs:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
        return {x: find(x) for x in parent}

    every = [(a[0], b[0]) for i, a in enumerate(signed) for b in signed[:i] if ((a[0] ^ b[0]) & (2**64 - 1)).bit_count() <= 4]
    assert roots(got) == roots(every)


def test_components_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_components(rows)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.fp % (1 << 64), r.component_id) == want[r.doc_id]


def test_odd_rows(spark):
    schema = "doc_id bigint, text string, fp string, component_id int, key array<int>"
    rows = [(5, None, "x", 1, [1]), (2, "", None, None, None), (9, "a b c d e", "y", 3, []), (9, "a b c d e", "y", 3, []), (None, "q r s", "", 0, None), (7, "w " * 200000, "", 0, None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (2, 2), (5, 2), (7, 7), (9, 9), (9, 9)]
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []
