"""Exact, near, passage and line de-duplication against SQL and brute force, and on awkward rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from compare import compare, open_tables
from corpus import edited, frame, prose

from skycadence.llm import catalog, suffix_family
from skycadence.llm.exact_dedup import exact_groups
from skycadence.llm.line_templates import CONSTANT, DEPTH, drop_recurring_lines
from skycadence.llm.setsketch import near_duplicates, one_of_each
from skycadence.llm.suffix_family import repeated_spans


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, sf01, name):
    assert compare(catalog.QUERIES[name](spark, sf01), open_tables(sf01), catalog.SQL[name]) is None


AWKWARD = [None, "", " \t\n", "a", "A", "a b", "a  b", "é", "x" * 120_000, "x" * 120_000, None, "ab" * 60_000 + " tail", "  z", "\x0b"]


# exact

def brute_exact(texts, ids):
    norm = [re.sub("[\\x20\\x09-\\x0D]", "", t or "") for t in texts]
    out = []
    for i, (t, n) in enumerate(zip(texts, norm)):
        group = [k for k in range(len(texts)) if norm[k] == n]
        keep = min(group, key=lambda k: (-len(texts[k] or ""), ids[k] is None, ids[k] or 0))
        out.append((ids[i], ids[keep], len(group), hashlib.sha256(n.encode()).hexdigest()))
    return out


def test_exact_brute_force(spark):
    texts, ids = AWKWARD + ["ab", "a b ", "b a"], [5, 4, None, 7, 6, 9, 8, -1, 20, 19, 2, 3, 30, 31, 40, 41, 41]
    got = exact_groups(frame(spark, texts, ids=ids)).collect()
    assert sorted(map(str, [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got])) == sorted(map(str, brute_exact(texts, ids)))
    assert exact_groups(frame(spark, [])).count() == 0


# near

def sets_of(text, width):
    low = (text or "").translate({k: k + 32 for k in range(65, 91)})
    words = [w for w in re.split("[\\x20\\x09-\\x0D]+", low) if w]
    return {tuple(words)} if 0 < len(words) < width else {tuple(words[k:k + width]) for k in range(len(words) - width + 1)}


def brute_near(texts, ids, width=4):
    sets = [sets_of(t, width) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    lows = {}
    for k in range(len(texts)):
        lows[find(k)] = min(lows.get(find(k), ids[k]), ids[k])
    return sorted((ids[k], len(sets[k]), lows[find(k)]) for k in range(len(texts)))


def test_near_families_around_the_threshold(spark):
    """Families whose members are just above or below the threshold of one another, chains, copies and loners."""
    rng = random.Random(1)
    texts = []
    for changes in (1, 3, 5, 8):
        base = prose(rng, 150)
        texts += [edited(rng, base, changes) for _ in range(45)]
    step = prose(rng, 200)
    for _ in range(30):
        step = edited(rng, step, 3)
        texts.append(step)
    texts += [texts[0]] * 40 + [prose(rng, 80) for _ in range(40)] + ["", "one two", "ONE two", "one"]
    ids = list(range(1000, 1000 + len(texts)))
    rng.shuffle(ids)
    got = sorted(map(tuple, near_duplicates(frame(spark, texts, ids=ids)).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == brute_near(texts, ids)


def test_near_awkward_rows(spark):
    texts = AWKWARD + ["p q r s t", "p q r s t", "P  q\tr s t"]
    ids = [3, 2, 5, None, 8, 9, 10, 11, 13, 12, 14, 15, 16, 17, None, 20, 20]
    got = near_duplicates(frame(spark, texts, ids=ids)).collect()
    assert len(got) == len(texts)
    by = {(r.doc_id, r.n_shingles): r for r in got}
    assert by[2, 0].component_id == 2 and by[14, 0].kept and by[13, 1].component_id == 12 and not by[13, 1].kept
    assert [r.component_id for r in got if r.doc_id is None] == [None, None] and all(r.kept for r in got if r.doc_id is None)
    assert by[20, 2].kept and near_duplicates(frame(spark, [])).count() == 0
    kept = one_of_each(frame(spark, texts, ids=ids), width=5)
    assert 13 not in [r.doc_id for r in kept.collect()] and kept.columns == frame(spark, []).columns


# passages

def brute_passages(texts, ids):
    data = [(t or "").encode() for t in texts]
    first = {}
    for d, i in zip(data, ids):
        if i is not None:
            for s in range(len(d) - 49):
                w = d[s:s + 50]
                first[w] = min(first.get(w, i), i)
    out = []
    for d, i in zip(data, ids):
        gone = bytearray(len(d))
        for s in range(len(d) - 49):
            if i is not None and first[d[s:s + 50]] < i:
                gone[s:s + 50] = b"\1" * 50
        out.append((i, len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(d, gone) if not g)))
    return sorted(out, key=str)


def test_passages_brute_force(spark):
    rng = random.Random(2)
    shared = [prose(rng, 30) for _ in range(4)]
    texts = [None, "", "short", "x" * 49, "x" * 50, "x" * 51, "x" * 400, "é" * 60, "é" * 61, "z" + "é" * 60]
    for _ in range(40):
        parts = [prose(rng, rng.randrange(1, 60))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) - 60)
            parts.append(s[a:a + rng.randrange(45, 60 + len(s) - a)])
            parts.append(rng.choice(["", "-", prose(rng, 3)]))
        texts.append("".join(parts))
    texts += texts[20:25]
    ids = [k * 3 % 101 for k in range(len(texts))]
    ids[4], ids[12], ids[13] = None, 50, 50
    got = repeated_spans(frame(spark, texts, ids=ids)).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got], key=str) == brute_passages(texts, ids)
    assert repeated_spans(frame(spark, [])).count() == 0


def boilerplate(rng, n):
    """Texts with one passage in different surroundings each, some of them repeated."""
    shared, around = prose(rng, 40), [prose(rng, 15) for _ in range(n // 2)]
    return [rng.choice(around) + shared + rng.choice(around) for _ in range(n)]


def test_a_common_gram_is_spread_over_partitions():
    """However many cells stand around one gram, a batch sends at most one entry of it to one partition."""
    rng = random.Random(11)
    texts = [t.encode() for t in boilerplate(rng, 400)]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = [f for _, _, f in suffix_family.sampled(np.frombuffer(b"".join(texts), np.uint8), offs)]
    batch = suffix_family._batch([f.key for f in found], [f.row for f in found], 64, [f.gram for f in found])
    at = {}
    for part, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("part", 1, "entries"))):
        if kind != 1:
            for gram in (suffix_family._unpack(blob)[0] >> np.uint64(32)).tolist():
                at.setdefault(gram, []).append(part)
    hot = max(at.values(), key=len)
    assert len(hot) > 100 and max(hot.count(p) for p in hot) < 0.1 * len(hot)


def test_passages_around_a_common_gram_in_many_batches(spark):
    rng = random.Random(12)
    texts = boilerplate(rng, 60) + [prose(rng, 30) for _ in range(5)]
    ids = rng.sample(range(1000), len(texts))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    for rows in (1, 2, 7, 10_000):
        spark.conf.set(size, rows)
        try:
            got = repeated_spans(frame(spark, texts, ids=ids)).collect()
        finally:
            spark.conf.set(size, before)
        assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got], key=str) == brute_passages(texts, ids)


def moved_bytes(spark, action):
    """The action's result, and what its stages wrote into shuffles."""
    spark.sparkContext.setJobGroup("moved", "")
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup("moved"))
    try:
        found = action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = {s for j in set(tracker.getJobIdsForGroup("moved")) - before for s in tracker.getJobInfo(j).stageIds}
    return found, sum(sc.statusStore().lastStageAttempt(s).shuffleWriteBytes() for s in stages)


def test_grams_that_are_equal_by_chance_move_little(spark):
    """Phrases longer than a gram stand in ever other company: nearly all cells are open, few passages repeat."""
    rng = random.Random(21)
    phrases = ["".join(rng.choices("abcdefgh", k=30)) for _ in range(300)]
    texts = [" ".join(rng.choices(phrases, k=150)) for _ in range(80)]
    ids = rng.sample(range(1000), len(texts))
    got, moved = moved_bytes(spark, lambda: repeated_spans(frame(spark, texts, ids=ids)).collect())
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got], key=str) == brute_passages(texts, ids)
    assert moved < 3 * sum(map(len, texts)), moved / sum(map(len, texts))


def test_arrays_cut_for_many_partitions_are_hardly_larger():
    rng = np.random.default_rng(5)
    keys, grams, docs = rng.integers(0, 1 << 63, 200_000, dtype=np.uint64), rng.integers(0, 1 << 63, 200_000, dtype=np.uint64), rng.integers(0, 500, 200_000)
    few, many = (sum(len(b.as_py()) for b in suffix_family._batch([keys], [docs], parts, [grams]).column("entries")) for parts in (8, 400))
    assert many < 1.06 * few, many / few


def test_rows_of_one_id_in_several_slots(spark):
    """Copies of a row, and rows that share an id, lie in different slots; they learn the same about the same passages."""
    rng = random.Random(22)
    a, b, c = (prose(rng, 40) for _ in range(3))
    texts, ids = [a + "1" + b, b + "2" + c, c + "3" + a] * 3 + [a, b, c, a + b, None, a], [5, 5, 5] * 3 + [5, 4, 9, 3, 5, None]
    got = repeated_spans(frame(spark, texts, ids=ids)).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got], key=str) == brute_passages(texts, ids)


def test_passages_whose_hashes_agree_in_32_bits_stay(spark):
    """Pairs of unlike cells, and of unlike parts of cells, around one gram whose hashes agree in their low halves."""
    pairs = [("edadgftrxtbgnilcduygxrloxxlompppyyucjorwfdgcloikkl", "bibutpqyckxnpilcduygxrloxxlompppyyucjqrgkhcmvpcedc"),
             ("wgjxkqcqmrpvzilcduygxrloxxlompppyyucjrihnzzfimzauc", "pgxidngnfqdgtilcduygxrloxxlompppyyucjyrtzoebljnqzw"),
             ("xsdgsiavvvcilcduygxrloxxlompppyyucjcuvxwcikbskiitwooy", "usygsiavvvcilcduygxrloxxlompppyyucjcuvxwcikbskiitwjoy"),
             ("pamgsiavvvcilcduygxrloxxlompppyyucjcuvxwcikbskiitwwpn", "ypfgsiavvvcilcduygxrloxxlompppyyucjcuvxwcikbskiitwkkb")]
    got = repeated_spans(frame(spark, [t for pair in pairs for t in pair])).collect()
    assert len(got) == 8 and all(r.n_removed == 0 for r in got)


def test_passages_in_texts_longer_than_a_piece(spark):
    rng = random.Random(3)
    long = "".join(rng.choices("abcdefgh ", k=1_200_000))
    at = (1 << 19) - 30  # across the seam between two pieces
    texts = ["q" * 80 + long[at:at + 70] + "r" * 80, long, long[1_000_000:1_000_200]]
    got = {r.doc_id: r for r in repeated_spans(frame(spark, texts)).collect()}
    assert (got[0].n_removed, got[1].n_removed, got[1].n_spans, got[2].n_removed) == (0, 70, 1, 200)


# lines

def brute_lines(texts, ids, verbatim):
    tokens = lambda x: ["<*>" if re.search("[0-9]", w) else w for w in re.split("[\\x20\\x09-\\x0D]+", x) if w]
    contents, holders_of = {}, {}
    for k, t in enumerate(texts):
        contents.setdefault(t or "", []).append(k)
    lines = [(c, number, tuple(w), line) for c in contents for number, line in enumerate(c.split("\n")) if (w := tokens(line))]
    for c, _, w, _ in lines:
        for pos, token in enumerate(w):
            holders_of.setdefault((len(w), w[:DEPTH], pos, token), set()).add(c)

    def template(w, line):
        fixed = [t if t != "<*>" and (p < DEPTH or len(holders_of[len(w), w[:DEPTH], p, t]) >= 2) else None for p, t in enumerate(w)]
        if sum(f is not None for f in fixed) >= CONSTANT * len(w) and (len(w) <= DEPTH or any(f is not None for f in fixed[DEPTH:])):
            return True, (len(w), w[:DEPTH], tuple(fixed))
        return False, (w, line) if verbatim else None

    holders = {}
    for c, _, w, line in lines:
        holders.setdefault(template(w, line), set()).add(c)
    low = {c: min([ids[k] for k in ks if ids[k] is not None], default=None) for c, ks in contents.items()}
    out = []
    for t, i in zip(texts, ids):
        drop = {True: set(), False: set()}
        for c, number, w, line in lines:
            kind = template(w, line)
            known = [x for x in holders[kind] if low[x] is not None]
            if c == (t or "") and kind[1] and len(holders[kind]) >= 2 and known and min(known, key=lambda x: (low[x], x)) != c:
                drop[kind[0]].add(number)
        kept = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in drop[True] | drop[False])
        out.append((i, kept, len((t or "").split("\n")) if t else 0, len(drop[True]) + len(drop[False]), len(drop[True]), len(drop[False])))
    return sorted(out, key=str)


@pytest.mark.parametrize("verbatim", [True, False])
def test_lines_brute_force(spark, verbatim):
    rng = random.Random(4)
    names = ["ann", "bob", "carl", "dora", "emil", "fay"]
    texts = AWKWARD + ["\n\n", "\nx\n"]
    for k in range(60):
        body = [prose(rng, rng.randrange(1, 25)) for _ in range(3)]
        extra = [f"Posted by {rng.choice(names)} on day {rng.randrange(99)} of the month", "All rights reserved .",
                 f"Copyright 20{rng.randrange(99)} Example Press", f"user {prose(rng, 5)} end", "Read more"]
        lines = body + [x for x in extra if rng.random() < 0.5]
        rng.shuffle(lines)
        texts.append("\n".join(lines))
    texts += [texts[20]] * 5 + [texts[21].replace("\n", "\r\n")]
    ids = [None if k % 17 == 5 else 500 - 3 * k for k in range(len(texts))]
    texts += ["p q r s t one\np q r s t two", "p q r x y one\np q r z z two", "p q r s t one\np q r x u one"]
    ids += [3000, 3001, 3002]
    got = drop_recurring_lines(frame(spark, texts, ids=ids).repartition(3), verbatim=verbatim)
    counts = ["n_lines", "n_dropped", "n_dropped_template", "n_dropped_verbatim"]
    assert sorted([(r.doc_id, r.text, *[r[c] for c in counts]) for r in got.collect()], key=str) == brute_lines(texts, ids, verbatim)
    assert got.columns == frame(spark, []).columns + counts
    assert drop_recurring_lines(frame(spark, [])).count() == 0


def test_a_token_in_two_lines_of_one_document_is_not_constant(spark):
    def left(*texts):
        return {r.doc_id: r.text for r in drop_recurring_lines(frame(spark, texts)).collect()}
    assert left("p q r s t one", "p q r x y one") == {0: "p q r s t one", 1: ""}
    assert left("p q r s t one\np q r s t two", "p q r x y one")[1] == ""
    assert left("p q r s t one\np q r s t two", "p q r u t six") == {0: "p q r s t one\np q r s t two", 1: ""}  # t is in both documents
    assert left("p q r s t one\np q r s t two", "p q r u v six")[1] == "p q r u v six"  # s and t are in one only


def test_many_recurring_lines_in_one_document(spark):
    lines = [f"alpha{k:c} beta{k:c} gamma{k:c} delta{k:c}" for k in range(0x4e00, 0x4e00 + 4000)]
    got = drop_recurring_lines(frame(spark, ["\n".join(lines), "\n".join(["own words here", *lines])]), verbatim=True).collect()
    assert {r.doc_id: (r.n_dropped, r.n_lines) for r in got} == {0: (0, 4000), 1: (4000, 4001)}
    assert {r.doc_id: r.text for r in got}[1] == "own words here"


def test_lines_repeated_word_for_word_and_lines_that_only_begin_alike(spark):
    long = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    texts = [f"{long}\nPage 1 of 10\nthe cat sat alpha", f"{long}\nPage 1 of 10\nthe cat sat bravo\nthe cat sat alpha",
             "Page 2 of 10\nthe cat sat delta", "7 8 9 7\nthe cat sat gamma", "7 8 9 7\n7 8 9 6"]
    got = {r.doc_id: r.text for r in drop_recurring_lines(frame(spark, texts), verbatim=True).collect()}
    assert got[0] == texts[0] and got[1] == "the cat sat bravo"
    assert got[3] == texts[3] and got[4] == "7 8 9 6"
    assert "the cat sat delta" in got[2]
