import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skyloom.llm import simhash as sh
from tests.llm.common import DOCS, ODD, docs, prose, words


def brute_print(text):
    w = words(text)
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(links):
    p = np.arange(len(links))
    while True:
        q = np.array([p[row].min() for row in links])
        q = q[q]
        if (q == p).all():
            return p
        p = q


def test_fingerprints(spark):
    texts = [*ODD, *(prose(i, 5 + 20 * i) for i in range(8)), "A b C d e"]
    got = {r.id: r.fp % (1 << 64) for r in sh.fingerprints(docs(spark, texts)).collect()}
    assert got == {i: brute_print(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("seed", range(8))
def test_trie_join_against_all_pairs(seed):
    rng = np.random.default_rng(seed)
    heart = rng.integers(0, 2**63, 6)
    fp = np.unique(np.array([int(heart[rng.integers(6)]) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in range(250)], np.uint64))
    want = closure(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    assert (sh.trie_join(np.zeros(len(fp), np.int64), fp) == want).all()


@pytest.mark.parametrize("seed", range(4))
def test_wide_trie_join_against_all_pairs(seed):
    rng = np.random.default_rng(seed)
    heart = rng.integers(0, 2**63, (4, 4), dtype=np.uint64)
    fp = heart[rng.integers(0, 4, 150)]
    for row in fp:
        for b in rng.choice(256, rng.integers(0, 40), replace=False):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    fp = fp[np.lexsort(fp.T[::-1])]
    key = np.sort(rng.integers(0, 2, len(fp)))
    alike = (np.bitwise_count(fp[:, None] ^ fp[None]).sum(2) <= 45) & (key[:, None] == key[None])
    assert (sh.trie_join(key, fp, 45) == closure(alike)).all()


def similarity(a, b):
    s = [set(zip(*(w[i:] for i in range(5)))) for w in (words(a), words(b))]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_near_copies_by_similarity(spark):
    base, texts = [prose(9000 + i, 400, 5000).split() for i in range(12)], []
    for i, w in enumerate(base):
        for edits in (0, 4, 40):
            e = list(w)
            for k in range(edits):
                e[(k * 397) // max(edits, 1)] = f"edit{i}x{edits}x{k}"
            texts.append(" ".join(e))
    got = {r.id: r.component for r in sh.near_copies(docs(spark, texts)).collect()}
    for i in range(0, len(texts), 3):
        assert similarity(texts[i], texts[i + 1]) > 0.88 and similarity(texts[i], texts[i + 2]) < 0.4
        assert got[i] == got[i + 1] == i and got[i + 2] == i + 2


def test_near_copies_of_odd_texts(spark):
    got = {r.id: r.component for r in sh.near_copies(docs(spark, [*ODD, "word", None, "one two", "two one"])).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 3, 7: 0, 8: 8, 9: 9}


def test_groups_against_all_pairs(spark):
    base = prose(1, 300).split()
    texts = []
    for i in range(40):
        w = list(base if i % 2 else prose(i, 300).split())
        for k in range(i % 5):
            w[(37 * i + 61 * k) % len(w)] = f"changed{i}"
        texts.append(" ".join(w))
    texts += [texts[0], texts[1], None, "", "  "]
    fp = np.array([brute_print(t) for t in texts], np.uint64)
    want = closure(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    got = {r.id: r.component for r in sh.near_groups(sh.fingerprints(docs(spark, texts))).collect()}
    assert got == {i: int(x) for i, x in enumerate(want)}


def test_drop_keeps_one_of_each_group(spark):
    odd = docs(spark, ["a b c d e", "a b c d e", "A b c d e", None, "", prose(1, 50)]).withColumns({"fp": F.lit(1), "id": F.lit("x"), "component": F.lit(0)})
    out = sh.drop_near_duplicates(odd)
    assert out.columns == odd.columns
    assert sorted(r.doc_id for r in out.collect()) == [0, 3, 5]


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert sh.near_groups(sh.fingerprints(empty)).count() == 0
    assert sh.drop_near_duplicates(empty).count() == 0


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_copies_against_all_pairs(spark):
    """Copies on either side of similarity 0.8, a shared frequent line, and a group larger than is compared at once."""
    rng, texts = np.random.default_rng(5), []
    for i in range(60):
        w = prose(300 + i, 100, 4000).split()
        texts.append(" ".join(w))
        e = list(w)
        for k in range(2 + i % 3):
            e[20 * k + 7] = f"new{i}x{k}"
        texts.append(" ".join(e))
    line = prose(1, 12, 4000)
    texts += [" ".join([prose(4000 + i, 40, 9000), *[line] * 30]) for i in range(50)]
    heart = prose(2, 120, 4000).split()
    for i in range(90):
        e = list(heart)
        for k in rng.choice(120, 1 + i % 4, replace=False):
            e[k] = f"other{i}x{k}"
        texts.append(" ".join(e))
    sets = [shingles(t) for t in texts]
    want = closure(np.array([[9 * len(a & b) >= 4 * (len(a) + len(b)) for b in sets] for a in sets]))
    got = {r.id: r.component for r in sh.near_copies(docs(spark, texts)).collect()}
    assert got == {i: int(x) for i, x in enumerate(want)}
    assert len(set(want[:120])) > 60 and len(set(want[120:170])) == 50


def test_equal_signs_of_different_sets_are_no_copies(spark):
    prints = spark.createDataFrame([(1, 7, 70), (2, 7, 70), (3, 7, 71), (4, 8, 80), (5, 7, 72), (5, 8, 80)], "id long, sign long, proof long")
    labelled = spark.createDataFrame([(7, 70, 1), (8, 80, 1)], "sign long, proven long, component long")
    assert {r.id: r.component for r in sh._proven(prints, labelled).collect()} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 1}


def test_second_hash_of_a_set_is_another():
    hashes, n = np.arange(1, 3001, dtype=np.uint64), np.full(1000, 3)
    one, two = sh._signs(hashes, n), sh._signs(hashes, n, sh.PROOF)
    assert len(set(one)) == len(set(two)) == 1000 and not set(one) & set(two)
    assert sh._signs(hashes[:0], np.array([0]), sh.PROOF).tolist() == [0]


@pytest.mark.parametrize("most", [sh.GROUP_SHINGLES, 3000])
def test_checked_groups_by_fingerprints_and_sets(spark, monkeypatch, most):
    """Only what fingerprints group is compared, and only sets of similarity 4/5 link there; large groups give the same."""
    monkeypatch.setattr(sh, "GROUP_SHINGLES", most)
    rng, texts = np.random.default_rng(8), []
    for i in range(30):
        w = prose(700 + i, 120, 4000).split()
        for k in (0, 1, 1, 3):
            e = list(w)
            for at in rng.choice(120, k, replace=False):
                e[at] = f"new{at}x{len(texts)}"
            texts.append(" ".join(e))
    heart = prose(3, 100, 4000).split()
    for i in range(60):
        e = list(heart)
        e[i] = f"other{i}"
        texts.append(" ".join(e))
    # Fingerprints are near, as shingles repeat, but few distinct ones are common.
    line = prose(4, 8, 4000)
    texts += [" ".join([line] * 40) + " " + prose(900 + i, 12, 9000) for i in range(6)]
    texts += [texts[0], texts[1], None, "", " "]
    sets, fp = [shingles(t) for t in texts], np.array([brute_print(t) for t in texts], np.uint64)
    group = closure(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    alike = np.array([[9 * len(a & b) >= 4 * (len(a) + len(b)) for b in sets] for a in sets])
    want = closure(alike & (group[:, None] == group[None, :]))
    got = {r.id: r.component for r in sh.checked_groups(docs(spark, texts)).collect()}
    assert {i: got.get(i, i) for i in range(len(texts))} == {i: int(x) for i, x in enumerate(want)}
    # The example has both: groups that the check parts, and like sets that fingerprints do not group.
    assert (want != group).any() and (closure(alike) != want).any()
    left = {r.doc_id for r in sh.drop_near_duplicates(docs(spark, texts)).collect()}
    assert left == {i for i, x in enumerate(want) if i == x}


def test_links_of_a_group_are_a_forest():
    rng = np.random.default_rng(2)
    heart = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.sort(np.concatenate([heart[10:], rng.integers(0, 2**63, 5).astype(np.uint64)])) for _ in range(200)] + [heart[:0], heart[:9]]
    table = sh.pa.table({"sign": np.arange(len(sets)), "shingles": sh.pa.array([np.sort(s).tobytes() for s in sets], sh.pa.binary())})
    links = sh._linked_sets(table)
    assert links.num_rows == 199 and max(links.column("b").to_pylist()) == 199
