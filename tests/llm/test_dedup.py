import hashlib
import random

import numpy as np
import pytest
import xxhash

from kvtable.llm import components, merkle, queries, simhash, suffix_dedup
from tests.sqlcheck import assert_same

# --- SimHash ------------------------------------------------------------------


def brute_fingerprint(text, n):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, now = [], ""
    for c in lowered + " ":
        if c == " " or "\x09" <= c <= "\x0d":
            if now:
                words.append(now)
            now = ""
        else:
            now += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return label


def families(seed, n):
    """Fingerprints in chains and clouds around a few centres, so that buckets fill up."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        fp = rng.getrandbits(64) if not out or rng.random() < 0.2 else rng.choice(out)
        for _ in range(rng.randint(0, 3)):
            fp ^= 1 << rng.randrange(64)
        out.append(fp)
    return out


@pytest.mark.parametrize(("radius", "parts"), [(0, 1), (1, 1), (2, 1), (4, 1), (5, 2), (9, 2)])
def test_masks_cover_every_pair_within_the_radius(radius, parts):
    masks, rng = simhash.covering_masks(radius, parts), random.Random(radius)
    assert len(masks) == parts * ((1 << (radius // parts + 1)) - 1)
    for _ in range(3000):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
        assert any(flips & m == 0 for m in masks)
    assert min(m.bit_count() for m in masks) >= 64 // parts // 4


@pytest.mark.parametrize(("radius", "parts", "bucket"), [(2, 1, 2048), (2, 1, 3), (9, 2, 2048), (9, 2, 5), (0, 1, 2048)])
def test_clusters_equal_brute_force(spark, monkeypatch, radius, parts, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    fps = families(radius + bucket, 300)
    rows = spark.createDataFrame(
        [(i if i % 7 else None, fp - (1 << 64) if fp >> 63 else fp) for i, fp in enumerate(fps)], "doc_id bigint, fp bigint"
    )
    got = {r["fp"] % (1 << 64): (r["component"], r["component_id"]) for r in simhash.clusters(rows, radius, parts).collect()}
    label = brute_components(fps, radius)
    for i, fp in enumerate(fps):
        members = [j for j in range(len(fps)) if label[j] == label[i]]
        assert got[fp][1] == min((j for j in members if j % 7), default=None)
    assert len({c for c, _ in got.values()}) == len(set(label))


def test_groups_that_span_batches():
    import pyarrow as pa

    fps = np.array(families(3, 400), np.uint64).view(np.int64)
    keys = np.sort(np.random.default_rng(0).integers(0, 6, 400))
    fps = fps[np.lexsort((fps, keys))]
    table = pa.table({"key": keys, "p": np.zeros(400, np.int32), "q": np.zeros(400, np.int32), "fp": fps})

    def joined(size):
        groups = simhash._whole_groups(iter(table.to_batches(max_chunksize=size)))
        return sorted(
            (a, b)
            for batch in simhash._forests(groups, 3)
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)
        )

    whole = joined(400)
    assert whole and joined(7) == whole == joined(1)


@pytest.mark.parametrize("often", [5_000, 1])
def test_simhash_rows(spark, edge, edge_rows, empty, clashing, often, monkeypatch):
    monkeypatch.setattr(simhash, "OFTEN", often)
    fps = [brute_fingerprint(r[1], 3) for r in edge_rows]
    label = brute_components(fps, 2)
    want = sorted(
        (str(r[0]), format(fps[i], "016x"), min((edge_rows[j][0] for j in range(len(fps)) if label[j] == label[i] and edge_rows[j][0] is not None), default=None))
        for i, r in enumerate(edge_rows)
    )
    for df in (edge, clashing):
        got = simhash.near_duplicates(df, 3, 2).collect()
        assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(empty, 3, 2).count() == 0


def test_simhash_query(spark, small):
    rows = queries.op7_simhash(spark, small).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    ids = sorted(texts)
    fps = [brute_fingerprint(texts[i], 3) for i in ids]
    label = brute_components(fps, 2)
    least = {g: min(i for i, x in zip(ids, label, strict=True) if x == g) for g in set(label)}
    want = sorted((i, format(f, "016x"), least[g]) for i, f, g in zip(ids, fps, label, strict=True))
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == want


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (7, 6), (200, 300), (300, 400), (400, 200)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 150)} | {300: 200, 400: 200}
    assert got == want
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- suffix array dedup -----------------------------------------------------------


def brute_spans(rows, span):
    first: dict[bytes, int] = {}
    key = lambda i: 2**63 if i is None else i
    for i, text in rows:
        data = (text or "").encode()
        for j in range(len(data) - span + 1):
            w = data[j : j + span]
            first[w] = min(key(i), first.get(w, key(i)))
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for j in range(len(data) - span + 1):
            if first[data[j : j + span]] < key(i):
                gone[j : j + span] = b"\1" * span
        edges = [k for k in range(len(data) + 1) if (k < len(data) and gone[k]) != (k > 0 and gone[k - 1])]
        out.append(list(zip([*edges[::2]], [*edges[1::2]], strict=True)))
    return out


def test_dedup_of_random_texts_in_small_runs(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BITS", 9)
    rng = random.Random(5)
    for trial in range(90):
        span, alphabet = rng.choice([25, 30, 50]), ("abcdefghij\0é", "ab", "\0a")[trial % 3]
        pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 140))) for _ in range(6)]
        fresh = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))  # noqa: B023, E731
        rows = [
            (rng.randint(0, 20), "".join(rng.choice(pool)[rng.randint(0, 30) :] if rng.random() < 0.6 else fresh() for _ in range(rng.randint(0, 4))))
            for _ in range(rng.randint(0, 25))
        ]
        n_runs, hot = rng.randint(1, 5), rng.choice([1, 2, 100])
        groups: list[list] = [[] for _ in range(n_runs)]
        for n, (i, t) in enumerate(rows):
            groups[rng.randrange(n_runs)].append((i, t, n))

        def run_of(group):
            rng.shuffle(group)  # a run's rows come in another order each time
            return suffix_dedup.Run([i for i, _, _ in group], [t for _, t, _ in group], span)  # noqa: B023

        runs = [run_of(g) for g in groups]
        seen: dict[int, tuple[int, bool, int]] = {}
        for run in runs:
            assert not len(run.unique) or (suffix_dedup._unpack_sorted(suffix_dedup._pack_sorted(run.unique)) == run.unique).all()
            for h, mark in zip(run.unique.tolist(), run.marks().tolist(), strict=True):
                n, inside, total = seen.get(h, (0, False, 0))
                seen[h] = (n + 1, inside or mark > suffix_dedup.MOST, total + mark % (suffix_dedup.MOST + 1))

        def flags(run):
            again = [seen[h][0] > 1 or seen[h][1] for h in run.unique.tolist()]  # noqa: B023
            return np.array(again, bool), np.array([seen[h][2] > hot for h in run.unique.tolist()], bool)  # noqa: B023

        texts = [t.encode() for _, t in rows if t and len(t.encode()) >= span]
        cuts = [rng.choice(texts) for _ in range(rng.randint(0, 6) if texts else 0)]
        splitters = sorted({t[(at := rng.randrange(len(t) - span + 1)) : at + span] for t in cuts})
        n_parts = len(splitters) + 1
        entries = [suffix_dedup.Entries(run, *flags(run), splitters) for run in runs]
        answers: list[dict] = [{} for _ in runs]
        for p in range(n_parts):
            sent = [r for r in range(n_runs) if entries[r].cuts[p] < entries[r].cuts[p + 1]]
            found = suffix_dedup.resolve_part([entries[r].coded(p) for r in sent], span)
            for r, a in zip(sent, found, strict=True):
                answers[r][p] = a
        got: list = [None] * len(rows)
        for r, group in enumerate(groups):
            run = run_of(group)
            for (_, _, n), spans in zip(group, suffix_dedup.Entries(run, *flags(run), splitters).spans(answers[r]), strict=True):
                got[n] = spans
        assert got == brute_spans(rows, span), trial


def test_loser_tree_merges_and_knows_the_prefixes():
    rng = random.Random(2)
    for _ in range(200):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(6)) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 7))]
        coded = []
        for run in runs:
            keys = [int.from_bytes(x, "big") for x in run]
            coded.append((keys, [0] * bool(keys) + [suffix_dedup._shared(a, b, 6) for a, b in zip(keys, keys[1:], strict=False)]))
        out = list(suffix_dedup.merged(coded, 6))
        values = [runs[r][i] for r, i, _ in out]
        assert values == sorted(x for run in runs for x in run)
        for (_, _, shared), a, b in zip(out[1:], values, values[1:], strict=False):
            common = next((k for k in range(6) if a[k] != b[k]), 6)
            assert shared == common


def test_suffix_dedup_rows(spark, edge, edge_rows, empty, clashing):
    want = sorted(
        (str(r[0]), str(r[1]), spans, suffix_dedup.cut((r[1] or "").encode(), spans))
        for r, spans in zip(edge_rows, brute_spans([(r[0], r[1]) for r in edge_rows], 50), strict=True)
    )
    for df, bounds in ((edge, {}), (edge, {"run_bytes": 2000, "hot": 2}), (clashing, {"run_bytes": 9000})):
        rows = suffix_dedup.dedup(df, **bounds).collect()
        got = sorted((str(r["doc_id"]), str(r["text"]), [tuple(s) for s in r["removed"]], bytes(r["kept"])) for r in rows)
        assert got == want
        assert set(rows[0].asDict()) == {*df.columns, "removed", "kept"}
    assert any(spans for _, _, spans, _ in want)
    assert suffix_dedup.dedup(empty).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.dedup(edge, span=20)


def test_suffix_query(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = sorted(
        (i, len(t.encode()), sum(b - a for a, b in s), len(s), hashlib.sha256(suffix_dedup.cut(t.encode(), s)).hexdigest())
        for (i, t), s in zip(docs, brute_spans(docs, 50), strict=True)
    )
    assert sorted(tuple(r) for r in queries.op8_suffix_dedup(spark, small).collect()) == want


def test_suffix_query_equals_its_sql(spark, small):
    assert_same(queries.op8_suffix_dedup(spark, small), queries.oracle_sql()["op8_suffix_dedup"], small)


def test_whole_characters():
    data = "aéb😀c".encode()
    assert suffix_dedup.whole_characters(data, [(1, 2), (2, 6)]) == [(3, 4)]
    assert suffix_dedup.whole_characters(data, [(0, 9)]) == [(0, 9)]


# --- Merkle trees --------------------------------------------------------------------


def brute_tree(text):
    """Sections of paragraphs of spans, by hand, and the root digest."""
    digest = lambda kind, data: hashlib.blake2b(data, digest_size=16, person=kind).digest()
    sections, open_section, digests, section_digests = [], [], [], []
    lines = text.split("\n")
    lines = [x + "\n" for x in lines[:-1]] + [x for x in lines[-1:] if x]
    for line in lines:
        spans, i = [], 0
        while i < len(line):
            start = i
            while i < len(line) and line[i] not in ".!?\n" and i < start + 16:
                i += 1
            while i < len(line) and line[i] in ".!?\n":
                i += 1
            while i < len(line) and line[i] == " ":
                i += 1
            spans.append(line[start:i])
        own = digest(b"paragraph", b"".join(digest(b"span", x.encode()) for x in spans))
        open_section.append(spans)
        digests.append(own)
        if not line.strip() or own[0] % 8 == 0 or line is lines[-1]:
            sections.append(open_section)
            section_digests.append(digest(b"section", b"".join(digests)))
            open_section, digests = [], []
    return sections, digest(b"document", b"".join(section_digests)).hex()


def flat(node):
    return node if isinstance(node, str) else "".join(map(flat, node))


def brute_pairs(a, b):
    """Equal beginnings, equal ends, and the heaviest chain of k-th occurrences between them, over all pairs."""
    x, y = [flat(n) for n in a], [flat(n) for n in b]
    start = end = 0
    while start < min(len(x), len(y)) and x[start] == y[start]:
        start += 1
    while end < min(len(x), len(y)) - start and x[len(x) - 1 - end] == y[len(y) - 1 - end]:
        end += 1
    pairs, used = [], set()
    for i in range(start, len(x) - end):
        j = next((j for j in range(start, len(y) - end) if y[j] == x[i] and j not in used), None)
        if j is not None:
            used.add(j)
            pairs.append((i, j))
    best = []
    for n, (i, j) in enumerate(pairs):
        weight, before = max([(best[m][0], -m) for m in range(n) if pairs[m][1] < j], default=(0, 1))
        best.append((weight + len(x[i]), -before if weight else -1))
    chain, n = [], max(range(len(best)), key=lambda n: (best[n][0], -n), default=-1)
    while n >= 0:
        chain.append(pairs[n])
        n = best[n][1]
    return [(i, i) for i in range(start)] + chain[::-1] + [(len(x) - k, len(y) - k) for k in range(end, 0, -1)]


def brute_likeness(text, other):
    """Likeness, and the places of ``text`` that lie under no aligned node."""
    if text == other:
        return 1.0, []
    kept = [False] * len(text)

    def go(a, b, at, level):
        last_i = last_j = 0
        for i, j in [*brute_pairs(a, b), (len(a), len(b))]:
            mine, theirs = a[last_i:i], b[last_j:j]
            if mine and theirs and level < 2:
                go([c for n in mine for c in n], [c for n in theirs for c in n], at, level + 1)
            at += len(flat(mine))
            if i < len(a):
                kept[at : at + len(flat(a[i]))] = [True] * len(flat(a[i]))
                at += len(flat(a[i]))
            last_i, last_j = i + 1, j + 1

    go(brute_tree(text)[0], brute_tree(other)[0], 0, 0)
    edges = [k for k in range(len(text) + 1) if (k < len(text) and not kept[k]) != (k > 0 and not kept[k - 1])]
    return 2.0 * sum(kept) / (len(text) + len(other)), list(zip(edges[::2], edges[1::2], strict=True))


def brute_report(rows):
    """In descending order of id, equal ids by XXH64 of the text; NULL ids each before the first."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    rows = [(i, t or "") for i, t in rows]
    numbered = sorted([r for r in rows if r[0] is not None], key=lambda r: (-r[0], signed(xxhash.xxh64_intdigest(r[1].encode(), 42))))
    pairs = [(i, t, numbered[(n + 1) % len(numbered)][1]) for n, (i, t) in enumerate(numbered)]
    pairs += [(i, t, numbered[0][1] if numbered else t) for i, t in rows if i is None]
    out = []
    for i, text, following in pairs:
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        near, at = brute_likeness(text, edited)
        out.append((str(i), len(text), hashlib.sha256(edited.encode()).hexdigest(), brute_tree(text)[1], brute_tree(edited)[1],
                    near, brute_likeness(text, following)[0], at))
    return sorted(out)


def report_rows(df):
    return sorted((str(r["doc_id"]), *tuple(r)[1:-1], [tuple(x) for x in r["edited_at"]]) for r in df.collect())


def test_edit_report(spark, edge, edge_rows, empty, clashing):
    want = brute_report([(r[0], r[1]) for r in edge_rows])
    for df in (edge, clashing, edge.repartition(7)):
        assert report_rows(merkle.edit_report(df)) == want
    assert merkle.edit_report(empty).count() == 0
    alone = edge.where("doc_id IS NULL")
    assert all(r["near_next"] == 1.0 for r in merkle.edit_report(alone).collect()) and merkle.edit_report(alone).count() == 2


def test_rows_that_repeat_an_id_are_no_single_range(spark):
    """Half of the rows share an id, and many of these their text; ranges end between them."""
    rows = [(7 if n % 2 else n, f"text {n % 5 if n % 2 else n}. " * 3) for n in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert report_rows(merkle.edit_report(docs)) == brute_report(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_order_counts_and_moves_are_edits():
    parts = [f"Section {i} tells of its own matter. It goes on for a while here.\n\n" for i in range(12)]
    a, b = "".join(parts), "".join(parts[::-1])
    likeness = merkle.compare(merkle.tree(a), merkle.tree(b))[0]
    assert likeness < 0.3 and abs(likeness - brute_likeness(a, b)[0]) < 1e-12
    moved = "".join(parts[1:] + parts[:1])
    assert 0.85 < merkle.compare(merkle.tree(a), merkle.tree(moved))[0] < 1


def test_likeness_of_random_edits():
    rng = random.Random(8)
    for _ in range(150):
        words = lambda n: " ".join(rng.choice(["ab", "cd", "ef.", "gh\n", "ij\n\n", "klmnopqrstuvwxyz"]) for _ in range(n))
        text = words(rng.randint(0, 60))
        other = text
        for _ in range(rng.randint(1, 4)):
            at, size = rng.randint(0, len(other)), rng.randint(0, 20)
            other = other[:at] + words(rng.randint(0, 5)) + other[at + size :]
        near, ours, theirs = merkle.compare(merkle.tree(text), merkle.tree(other))
        assert (near, ours) == brute_likeness(text, other)
        kept = sum(b - a for a, b in ours), sum(b - a for a, b in theirs)
        if text != other:
            assert len(text) - kept[0] == len(other) - kept[1]  # the same text on both sides
            left = lambda t, gone: "".join(c for k, c in enumerate(t) if not any(a <= k < b for a, b in gone))
            assert left(text, ours) == left(other, theirs)


def test_trees_cover_the_text_and_locate_edits():
    text = "\n".join(f"Paragraph {i} has a few words. It has a second sentence too." for i in range(60)) + "\n\nlast\r\n"

    def leaves(node):
        return [node] if node.children is None else [x for c in node.children for x in leaves(c)]

    tree = merkle.tree(text)
    assert tree.size == len(text) == sum(x.size for x in leaves(tree))
    assert merkle.tree(text).digest == tree.digest
    other = text.replace("Paragraph 30 has", "Paragraph 30 had")
    likeness, ours, theirs = merkle.compare(tree, merkle.tree(other))
    at = text.index("Paragraph 30 has")
    assert 0.97 < likeness < 1 and len(ours) == len(theirs) == 1 and ours[0][0] <= at + 13 < ours[0][1]
    assert merkle.compare(merkle.tree(""), merkle.tree(None))[0] == 1.0
    assert merkle.compare(merkle.tree("abc"), merkle.tree(""))[0] == 0.0
    shifted = "A new first line.\n" + text
    assert merkle.compare(tree, merkle.tree(shifted))[0] > 0.95
    a, b = merkle.tree(text), merkle.tree(other)
    assert merkle.compare(a, b)[0] == merkle.compare(b, a)[0]
    assert len({merkle.tree(t).digest for t in ["", " ", "\n", "a", "a\n", "a b", "ab"]}) == 7


def test_fingerprints_column(edge, edge_rows, empty, clashing):
    for df in (edge, clashing):
        got = merkle.fingerprints(df).collect()
        assert sorted(r["fingerprint"] for r in got) == sorted(merkle.tree(r[1]).digest.hex() for r in edge_rows)
        texts = {}
        for r in got:
            assert texts.setdefault(r["text"] or "", r["fingerprint"]) == r["fingerprint"]
    assert merkle.fingerprints(empty).count() == 0


def test_fingerprint_query(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert report_rows(queries.op9_fingerprints(spark, small)) == brute_report(docs)
