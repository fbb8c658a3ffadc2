"""The text operators on small fixtures, against brute force, round trips or held-out accuracy."""

import collections
import hashlib
import itertools
import os
import re
import uuid
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sheaf.llm import fingerprints, lines, mixing, neardup, packing, pii, quality, queries, search, secrets, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, node int, copies int, class_id long, _id string, at int"


def documents(spark, rows):
    """(doc_id, text[, source]) as documents with more columns whose names clash with ours."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or ""), "x", 7, 9, 5, "i", 3) for r in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")


ODD = [(10**9, ""), (10**9 + 1, None), (None, "no id"), (10**9 + 2, "again"), (10**9 + 2, "again"), (10**9 + 3, "word " * 30_000)]


# 1: near-duplicates


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def shingle_weights(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else collections.Counter()


def probability_jaccard(a, b):
    if set(a.values()) | set(b.values()) <= {1}:
        return 0.0  # the plain one is the same
    groups = collections.Counter((a.get(x, 0), b.get(x, 0)) for x in set(a) | set(b))
    return sum(n / sum(m * max(p / x, q / y) for (p, q), m in groups.items()) for (x, y), n in groups.items() if x and y)


def brute_classes(rows):
    texts = sorted({t or "" for _, t in rows})
    weights, parent = [shingle_weights(t) for t in texts], list(range(len(texts)))
    sets = [frozenset(w) for w in weights]

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for x in s for j in holders[x] if j < i).items():
            if n / (len(s) + len(sets[j]) - n) >= 0.8 or probability_jaccard(weights[i], weights[j]) >= 0.8:
                parent[find(i)] = find(j)
    number = {t: i for i, t in enumerate(texts)}
    least = {}
    for i, t in rows:
        root = find(number[t or ""])
        least[root] = min((x for x in (least.get(root), i) if x is not None), default=None)
    return sorted(((i, least[find(number[t or ""])]) for i, t in rows), key=str)


def test_near_duplicates_match_brute_force(spark, docs):
    rng = np.random.RandomState(3)
    base = [f"w{x}" for x in rng.randint(0, 5000, 200)]
    near = [(2 * 10**6 + i, " ".join(base[:k] + [f"new{i}"] + base[k + 1 :])) for i, k in enumerate(rng.randint(0, 200, 60))]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + near + ODD + [(5, "a b"), (6, "a b"), (7, "a b c d e f")]
    got = neardup.classes(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == brute_classes(rows)
    kept = neardup.first_of_each(documents(spark, rows))
    assert kept.columns == documents(spark, rows[:1]).columns
    assert kept.count() == len({c for _, c in brute_classes(rows)})


def test_near_duplicates_of_nothing(spark):
    assert neardup.classes(documents(spark, [])).count() == 0
    assert neardup.first_of_each(documents(spark, [])).count() == 0


def test_copies_near_only_their_original_are_one_class(spark):
    rng = np.random.RandomState(8)
    base = [f"w{x}" for x in rng.randint(0, 10**6, 400)]
    rows = [(0, " ".join(base))]
    for i in range(1, 1001):
        words = list(base)
        for k in rng.choice(80, 8, replace=False) * 5:  # no shingle twice: every copy is at 0.818
            words[k + 2] = f"new{i}x{k}"
        rows.append((i, " ".join(words)))
    got = neardup.classes(documents(spark, rows)).collect()
    assert collections.Counter(r.class_id for r in got) == {0: 1001}


def test_copies_that_repeat_a_line_more_often_are_one_class(spark):
    rng = np.random.RandomState(9)
    base, line = " ".join(f"w{x}" for x in rng.randint(0, 10**6, 400)), " one line of ten words that comes again and again"
    rows = [(i, base + line * n) for i, n in enumerate((1, 40, 100))] + [(3, " ".join(f"v{x}" for x in rng.randint(0, 10**6, 400)) + line * 40)]
    assert brute_classes(rows) == [(0, 0), (1, 0), (2, 0), (3, 3)]
    got = neardup.classes(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == brute_classes(rows)


def test_weighted_pairs_match_brute_force(spark):
    """Texts near one another by weights alone, by sets alone, by both, and just beyond."""
    rng = np.random.RandomState(11)
    rows = []
    for g in range(60):
        words = [f"g{g}w{x}" for x in rng.randint(0, 10**6, 60)]
        line = " ".join(f"g{g}l{x}" for x in range(10))
        many = int(rng.randint(2, 40))
        rows.append((10 * g, " ".join(words) + f" {line}" * many))
        rows.append((10 * g + 1, " ".join(words[: int(rng.randint(20, 60))]) + f" {line}" * many))  # by weights
        rows.append((10 * g + 2, " ".join(words) + f" {line}" * int(rng.randint(1, 60))))  # by sets
        changed = list(words)
        for k in rng.choice(60, 2, replace=False):
            changed[k] = f"new{g}x{k}"
        rows.append((10 * g + 3, " ".join(changed) + f" {line}" * many))
    got = neardup.classes(documents(spark, rows)).collect()
    want = sorted(brute_classes(rows))
    assert len({c for _, c in want}) < 130
    assert sorted((r.doc_id, r.class_id) for r in got) == want


def test_signature_estimates_probability_jaccard():
    rng = np.random.RandomState(1)
    both = rng.randint(1, 2**60, 300).astype(np.uint64)
    a, b = np.concatenate([both, both[:50]]), np.concatenate([both[:240], rng.randint(1, 2**60, 60).astype(np.uint64)])
    kept = neardup.signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 2, slots=4096)
    x, nx = np.unique(a, return_counts=True)
    wa, wb = dict(zip(x.tolist(), nx.tolist(), strict=True)), collections.Counter(b.tolist())
    every = set(wa) | set(wb)
    exact = sum(1 / sum(max(wa.get(y, 0) / wa[e], wb.get(y, 0) / wb[e]) for y in every) for e in set(wa) & set(wb))
    assert abs((kept[0] == kept[1]).mean() - exact) < 0.03


# 2 and 7: spans

SECRET = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}
PRIVATE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def fits(kind, m):
    digits = re.sub("[^0-9]", "", m[0])
    return {
        "assign": lambda: len(m[2]) >= 6, "access": lambda: len(m[0]) >= 20, "hex": lambda: len(m[0]) >= 24, "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15,
    }[kind]()


SPAN_TEXTS = [
    "", None, "a@b.c_d@e.f 1.2.3.4.5.6.7.8 999.1.1.1 0001.002.3.255", "4111 1111 1111 1111 x +1 (743) 555-3824. +1+2345678901 4111-1111-1111-1111 2",
    "secret:token:abcdefg token=token=abcdef API_KEY = 'abc.def=1' passwd:abc", "AKIA" + "A" * 16 + " AKIAAKIA123 " + "abcdef0123" * 4, "1.2.3.4 " * 300 + "x@y.zz" * 200,
    "é@x.y üü 1.1.1.1 tok€n token=ééabcdef", "x" * 60_000, "4 " * 20_000, "+1" + " " * 20_000, "deadbeef" * 5_000,
]


def spans_of(patterns, text, by_start):
    found = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(patterns.items()) for m in p.finditer(text or "") if fits(k, m)]
    found.sort(key=(lambda x: x[:2]) if by_start else (lambda x: (x[1], x[0])))
    return ",".join(f"{k}:{a}:{z}" for a, _, k, z in found), collections.Counter(k for _, _, k, _ in found)


def fresh_ledger(spark, tmp_path):
    return secrets.Ledger(spark, f"file://{tmp_path}/ledger-{uuid.uuid4().hex}")


@pytest.mark.parametrize(("which", "patterns", "by_start"), [("secrets", SECRET, True), ("pii", PRIVATE, False)])
def test_spans_match_python(spark, docs, which, patterns, by_start, tmp_path):
    digest = {"secrets": lambda d: secrets.digest(d, fresh_ledger(spark, tmp_path)), "pii": lambda d: pii.digest(pii.detect(d))}[which]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10**6 + i, t) for i, t in enumerate(SPAN_TEXTS)] + [(10**6, "")]
    texts = dict(rows)
    got = digest(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        said, many = spans_of(patterns, texts[r.doc_id], by_start)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), r.doc_id
        assert all(r[f"n_{k}"] == many[k] for k in patterns)
        base = [s for s in r.spans.split(",") if s.split(":")[0] in patterns]
        assert ",".join(base) == said
    assert digest(documents(spark, [])).count() == 0


def test_pii_checks(spark):
    rows = [(1, "pay DE89 3704 0044 0532 0130 00 to my bank"), (2, "DE89 3704 0044 0532 0130 01"), (3, "social security 123-45-6789"), (4, "part 123-45-6789")]
    got = {r.doc_id: (r.spans, r.scores) for r in pii.digest(pii.detect(documents(spark, rows))).collect()}
    assert got[1][0].startswith("iban:4:") and got[1][1] == [1.0]
    assert got[2][0] == "" and got[3][0].startswith("ssn:") and got[4][0] == ""


def test_account_numbers_end_before_what_follows(spark):
    numbers = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "DE89370400440532013000", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"]
    after = [" BIC COBADEFFXXX", " 2024-01-01", " EUR 500", " NOK", ", DE89 3704 0044 0532 0130 01 X"]
    rows = [(i, f"IBAN {n}{x}") for i, (n, x) in enumerate(zip(numbers, after, strict=True))] + [(9, "REF AB12 DE89 3704 0044 0532 0130 00 OK")]
    got = {r.doc_id: r.spans for r in pii.digest(pii.detect(documents(spark, rows))).collect()}
    assert got == {i: f"iban:5:{5 + len(n)}" for i, n in enumerate(numbers)} | {9: "iban:9:36"}


def test_ledger_scans_only_what_is_new(spark):
    first = documents(spark, [(1, "token=abcdef12"), (2, "nothing")])
    ledger = secrets.as_ledger(secrets.scan(secrets.addressed(first).select("blob", "text")))
    assert ledger.count() == 2 * len(secrets.RULES)
    both = documents(spark, [(1, "token=abcdef12"), (3, "token=abcdef12"), (4, "secret: zzzzzzzz")])
    again = secrets.scan(secrets.addressed(both).select("blob", "text"), ledger)
    assert again.count() == 1
    partial = ledger.filter(F.col("rule_version") != secrets.rule_version("assign"))
    redo = secrets.scan(secrets.addressed(first).select("blob", "text"), partial)
    assert [f.rule_version for r in redo.collect() for f in r.found] == [secrets.rule_version("assign")] * 2


def test_ledger_is_kept_over_three_versions(spark, tmp_path, monkeypatch):
    """Three successive versions of the documents, a rule raised between the second and the third."""
    ledger, rules = fresh_ledger(spark, tmp_path), len(secrets.RULES)
    versions = [
        [(1, "token=abcdef12"), (2, "nothing")],
        [(1, "token=abcdef12 more"), (2, "nothing"), (3, "token=abcdef12")],
        [(1, "token=abcdef12 more"), (2, "deadbeef" * 4), (4, "nothing")],
    ]
    scanned = []
    for k, rows in enumerate(versions):
        if k == 2:
            monkeypatch.setitem(secrets.RULES, "hex", (2, secrets.RULES["hex"][1]))
        frame = documents(spark, rows)
        scanned.append(ledger.update(secrets.addressed(frame).select("blob", "text")))
        assert ledger.update(secrets.addressed(frame).select("blob", "text")) == 0
        got = {r.doc_id: (r.n_assign, r.n_hex, r.spans) for r in secrets.digest(frame, ledger).collect()}
        want = {i: spans_of(SECRET, t, True) for i, t in rows}
        assert got == {i: (many["assign"], many["hex"], said) for i, (said, many) in want.items()}
    # two blobs; one new blob; one new blob, and the raised rule on the two that came again
    assert scanned == [2 * rules, rules, rules + 2]
    assert ledger.rows().groupBy("blob", "rule_version").count().filter("count > 1").isEmpty()


# 3: mixing


def water_level(sizes, weights, most=3):
    total, capped = sum(sizes.values()), {}
    while True:
        left = {s: w for s, w in weights.items() if s not in capped}
        share = {s: (total - sum(capped.values())) * w / sum(left.values()) for s, w in left.items()} if left else {}
        over = {s for s, x in share.items() if x > most * sizes[s]}
        if not over:
            return capped | share
        capped |= {s: most * sizes[s] for s in over}


def test_mixing_meets_targets(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 16)
    monkeypatch.setattr(mixing, "FAN", 3)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()] + [(9001, "a b c", None), (9001, "a b c", None), (9002, None, "empty"), (None, "x y", "src1")]
    frame = documents(spark, rows)
    got = mixing.mix(mixing.sized(frame)).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 3 * got["size"]).all()
    words = collections.Counter()
    for _, t, s in rows:
        words[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(words, key=lambda s: (s is None, s or ""))
    want = water_level(words, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    got["source"] = got["source"].where(got["source"].notna(), None)
    longest = got["size"].max()
    for s, part in got.groupby("source", dropna=False):
        s = None if not isinstance(s, str) else s
        assert part["source_size"].iloc[0] == words[s]
        assert part["target"].iloc[0] == pytest.approx(want[s])
        assert abs(part["taken"].sum() - want[s]) <= longest
    again = mixing.mix(mixing.sized(frame.repartition(7))).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert sorted(map(str, again[key].values.tolist())) == sorted(map(str, got[key].values.tolist()))
    mixed = mixing.mixed_documents(frame)
    assert mixed.columns == frame.columns and mixed.count() == got["copies"].sum()


def test_mixing_lands_near_the_target_beside_a_long_document(spark, monkeypatch):
    rng = np.random.RandomState(12)
    rows = [(i, "w " * int(n), "a") for i, n in enumerate(rng.randint(150, 450, 500))] + [(600, "w " * 100_000, "a")]
    rows += [(1000 + i, "w " * int(n), "b") for i, n in enumerate(rng.randint(1, 90, 900))] + [(2000, "w " * 3_000, "b"), (2001, "w", "c")]
    found = []
    for bucket in (4096, 64):  # one level of flight, then several: the same care
        monkeypatch.setattr(mixing, "BUCKET", bucket)
        got = mixing.mix(mixing.sized(documents(spark, rows)))
        assert got.columns[:7] == ["doc_id", "size", "source_size", "target", "taken", "source", "copies"]
        got = got.toPandas()
        for _, part in got.groupby("source"):
            assert abs(part["taken"].sum() - part["target"].iloc[0]) <= max(1.0, 0.002 * part["target"].iloc[0]) + part["size"].min() * 8
            assert (part["taken"] <= 3 * part["size"]).all()
        found.append(got)


def test_mixing_nothing(spark):
    assert mixing.mix(mixing.sized(documents(spark, []))).count() == 0
    assert mixing.mixed_documents(documents(spark, [])).count() == 0


def test_flight_keeps_totals():
    import random

    rng = np.random.RandomState(0)
    sizes, chances = rng.randint(1, 500, 400).astype(float).tolist(), rng.rand(400).tolist()
    out = mixing.flight(sizes, chances, random.Random(1))
    assert sum(0 < x < 1 for x in out) <= 2
    assert sum(out) == pytest.approx(sum(chances)) and np.dot(sizes, out) == pytest.approx(np.dot(sizes, chances))


# 4: lines


def test_lines_match_brute_force(spark, docs):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()] + [(10**6 + i, f"own line number {i}\n shared by many sites \nshort", f"site{i % 7}") for i in range(30)]
    rows += [(10**6 + 50 + i, f"three ways to end this line{e}\nrest {i}", f"end{i}") for i, e in enumerate(("", "\r", "\t", " ", "\r", ""))]
    rows += [(10**7, None, None), (10**7 + 1, "shared by many sites", None), (10**7 + 1, "shared by many sites", None), (10**7 + 2, "", "s")]
    sites, first = collections.defaultdict(set), {}
    for i, t, s in rows:
        for k, line in enumerate((t or "").split("\n")):
            line = line.strip(" \t\r\v\f")
            if len(line) >= lines.MIN_CHARS:
                sites[line].add(s or "")
                first[line] = min(first.get(line, (i, k)), (i, k))
    want = []
    for i, t, _ in rows:
        keep = [x for k, x in enumerate((t or "").split("\n")) if len(sites.get(x.strip(" \t\r\v\f"), ())) < lines.MIN_SITES or first[x.strip(" \t\r\v\f")] == (i, k)]
        want.append((i, None if t is None else "\n".join(keep)))
    got = lines.dedup(documents(spark, rows))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert lines.dedup(documents(spark, [])).count() == 0


# 5: packing


def test_packing_round_trip(spark, docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    rows = [(r.doc_id, r.text) for r in docs.collect()] + ODD[:2] + [(77_000, "tabs\tand  spaces \n\n x "), (77_001, "Ελληνικά 中文 😀 <|endoftext|> x"), (77_002, "a b c " * 4000), (77_002, "a b c " * 4000)]
    exact = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: exact.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}
    got = packing.pack(documents(spark, rows), window=64).toPandas()
    copies = collections.Counter(i for i, _ in rows)
    assert got["length"].sum() == sum(len(ids[i]) for i, _ in rows)
    for r in got.itertuples():
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert len(part) == 4 * r.length and zlib.crc32(part) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for i, part in got.groupby("doc_id"):
        covered = collections.Counter(k for a, n in zip(part["start"], part["length"], strict=True) for k in range(a, a + n))
        assert set(covered.values()) == {copies[i]} and len(covered) == len(ids[i])
    padding = 0
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *np.cumsum(part["length"])[:-1]]
        n = int(part["length"].sum())
        assert n <= 1024
        padding += 0 if n & (n - 1) == 0 else 1024 - n
    assert padding == 0
    assert packing.pack(documents(spark, [])).count() == 0


def test_balance_takes_the_cheapest_sequence():
    placed = packing.balance([(600, 0), (500, 1), (400, 2), (548, 3)], [1024, 1024], 1.0, 1.0, 1024)
    assert sum(n for *_, n, _, _ in placed) == 2048
    assert [(i, j) for i, _, _, j, _ in placed[:2]] == [(0, 0), (3, 1)]


# 6: search


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "ROW_BLOCK", 64)
    monkeypatch.setattr(search, "QUERY_BYTES", 3 * 8 * 16)
    monkeypatch.setattr(search, "QUERY_ROWS", 2)
    rng = np.random.RandomState(5)
    rows = [(i, rng.randn(16).round(2).tolist()) for i in range(900)] + [(i, [0.5] * 16) for i in range(900, 1000)]
    rows += [(1001, None), (1002, [float("nan")] * 16), (1003, [None] * 16), (None, [1.0] * 16), (1100, [1.0, 2.0]), (1101, [3.0, 4.0]), (1200, []), (5, rows[5][1])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(5)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in search.top_k(frame).collect()}
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for q, v in good:
        if q % 100 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))
            want |= {(q, k): (i, -s) for k, (s, i) in enumerate(found[:10], 1)}
    assert got == want
    assert search.top_k(frame.limit(0)).count() == 0


def test_top_k_of_long_and_large_vectors_is_exact(spark):
    rng = np.random.RandomState(7)
    rows = [(i, (rng.randint(-(2**20), 2**20, 40_000) / 1024).tolist()) for i in range(12)] + [(100, [1e300, -1e300, 1e18]), (101, [1e300, 1.0, 1.0]), (102, [-1.0, 1.0, 2.0**60])]
    assert not search.exact_together(np.full((1, 40_000), 2.0**20), np.full((1, 40_000), 2.0**20))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()}
    whole = {i: [int(np.floor(1024 * x)) if abs(x) < 1e200 else int(x) * 1024 for x in v] for i, v in rows}
    want = {}
    for q in (0, 100):
        score = lambda i: min(2**63 - 1, max(-(2**63), sum(a * b for a, b in zip(whole[q], whole[i], strict=True))))  # noqa: B023, E731
        found = sorted((-score(i), i) for i, v in rows if i != q and len(v) == len(whole[q]))
        want |= {(q, k): (i, -s) for k, (s, i) in enumerate(found[:10], 1)}
    assert got == want


def test_search_resolves_only_what_its_lists_reach():
    rng = np.random.RandomState(3)
    lists = [rng.randint(-99, 99, (2, 50)).astype(float) for _ in range(4)]
    cut = np.array([150, search.LEAST])
    qs, rs = search.reached(lists, [search.share_of(cut)[:, None]] * 4)
    held = set(zip(qs.tolist(), rs.tolist(), strict=True))
    assert {r for q, r in held if q == 1} == set(range(50))
    assert {(0, r) for r in range(50) if sum(s[0, r] for s in lists) >= 150} <= held
    assert {r for q, r in held if q == 0} == {r for r in range(50) if max(s[0, r] for s in lists) >= 38}
    assert search.resolved(lists, qs, rs).tolist() == [int(sum(s[q, r] for s in lists)) for q, r in zip(qs, rs, strict=True)]


# 8 and 9: classifiers


@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.9), (toxicity, "toxic", 0.85)])
def test_held_out_accuracy(spark, module, label, least):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = module.train(docs, labels)
    odd = documents(spark, ODD).select("doc_id", "text")
    got = module.score(docs.select("doc_id", "text").unionByName(odd), model).toPandas()
    assert len(got) == docs.count() + len(ODD) and got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= 0.3)).all()
    known = got[got["doc_id"].notna()]
    folds, held = module.FOLDS, module.HELD
    assert (known["held_out"] == [zlib.crc32(str(int(i)).encode()) % folds == held for i in known["doc_id"]]).all()
    both = labels.toPandas().merge(got, on="doc_id")
    apart = both[both["held_out"]]
    assert (apart[label] == apart["predicted"]).mean() >= least
    assert module.score(documents(spark, []), model).count() == 0
    none = labels.filter("doc_id < 0")
    assert module.train(docs, none) is None
    assert module.score(docs, None).select("score").distinct().count() == 1


def test_toxicity_recall_and_precision(spark):
    """On the held-out fold of sf0.1, which always 0 or always 1 fails; sf0.01 holds 14 toxic documents there, too few to tell."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.score(docs, toxicity.train(docs, labels)).filter("held_out").join(labels, "doc_id").select("toxic", "predicted").toPandas()
    hits, real, said = int((got["toxic"] & got["predicted"]).sum()), int(got["toxic"].sum()), int(got["predicted"].sum())
    assert hits >= 0.8 * real > 0, (hits, real)
    assert hits >= 0.9 * said > 0, (hits, said)


def test_toxicity_learns_shouting_and_calls(spark):
    rng = np.random.RandomState(6)
    rows = []
    for i in range(400):
        text = " ".join(f"w{x}" for x in rng.randint(0, 60, 20)) + " you see where they are"
        rows.append((i, text if i % 2 else f"{text} you are an idiot ! ! !".upper(), 1 - i % 2))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(documents(spark, [r[:2] for r in rows]), labels)
    shout, call = model.weights[len(model.entries) : len(model.entries) + 2]
    assert shout > 0.5 and call > 0.5


def test_marginals_match_enumeration():
    rng = np.random.RandomState(2)
    per, pair = np.array([1, 4, 3]), rng.randn(2, 2)
    good = rng.randn(8)
    got, counts = quality.forward_backward(good, per, pair)
    want, expected, at = [], np.zeros((2, 2)), 0
    for n in per:
        weights, labels = [], list(itertools.product((0, 1), repeat=int(n)))
        for ys in labels:
            weights.append(np.exp(sum(g for g, y in zip(good[at : at + n], ys, strict=True) if y) + sum(pair[a, b] for a, b in itertools.pairwise(ys))))
        weights = np.array(weights) / sum(weights)
        want += [sum(w for w, ys in zip(weights, labels, strict=True) if ys[k]) for k in range(n)]
        for w, ys in zip(weights, labels, strict=True):
            for a, b in itertools.pairwise(ys):
                expected[a, b] += w
        at += n
    assert np.allclose(got, want) and np.allclose(counts, expected)


def test_label_model_finds_the_better_voters():
    rng = np.random.RandomState(4)
    truth = rng.rand(3000) < 0.3
    votes = np.stack([np.where(rng.rand(3000) < p, truth, ~truth).astype(int) for p in (0.95, 0.9, 0.85, 0.6)], axis=1)
    votes = np.concatenate([votes, votes[:, 3:]], axis=1)  # the worst voter twice
    post, rates, shared = toxicity.label_model(votes, 0.3)
    assert ((post > 0.5) == truth).mean() > 0.95
    assert rates[0, 1, 2] > rates[3, 1, 2] and shared[3, 4] > 0.9


# 10: fingerprints


def brute_print(text):
    words = re.split(r"[\x20\x09-\x0D]+", text)
    votes, total = [0] * 64, 0
    for k, a in enumerate(words):
        b = words[k + 1] if k + 1 < len(words) else None
        length = len(a) + len(b or "")
        weight = min(4, 1 + length // 5) if length else 0
        h = xxhash.xxh64_intdigest(a.encode(), seed=42)
        h = h if b is None else xxhash.xxh64_intdigest(b.encode(), seed=h)
        total += weight
        for j in range(64):
            votes[j] += weight * (h >> j & 1)
    return sum(1 << j for j in range(64) if 2 * votes[j] > total)


def test_null_and_repeated_ids_are_split(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_BLOCK", 4)
    rows = [(None, f"no id {k % 97} {k}") for k in range(300)] + [(7, f"one id {k}") for k in range(300)] + [(k, f"own {k}") for k in range(50)] + [(7, "same")] * 5
    frame = documents(spark, rows).select("doc_id", "text")
    found = fingerprints.blocks(frame).filter("not guest").groupBy("block").count().toPandas()
    assert len(found) > 80 and found["count"].max() < 40
    got = fingerprints.compared(frame).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        want.append((i, hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)


def test_fingerprints(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + ODD + [(-5, "same words here"), (10**10, "same words here")]
    got = fingerprints.compared(documents(spark, rows)).collect()
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(ordered):
        half = len(t) // 2
        after = ordered[(k + 1) % len(ordered)][1]
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
    prints = collections.defaultdict(set)
    texts = dict(rows)
    for r in got:
        prints[texts[r.doc_id] or ""].add(r.fingerprint)
    assert all(len(x) == 1 for x in prints.values())
    long = [r for r in got if r.n_chars > 300 and r.doc_id != 10**9 + 3]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.9
    body = {(r.doc_id, r.edited_sha256): r for r in got}
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = body[i, hashlib.sha256(edited.encode()).hexdigest()]
        own, other, following = brute_print(t), brute_print(edited), brute_print(after)
        assert (r.fingerprint, r.edited_fingerprint) == (f"{own:016x}", f"{other:016x}")
        assert r.near_edited == 1 - (own ^ other).bit_count() / 64
        if sum(x == i for x, _ in rows) == 1:
            assert r.near_next == 1 - (own ^ following).bit_count() / 64
    one = fingerprints.compared(documents(spark, [(1, "only one")])).first()
    assert one.near_next == 1.0
    assert fingerprints.compared(documents(spark, [])).count() == 0


def test_links_match_brute_force(spark):
    rng = np.random.RandomState(0)
    base = rng.randint(0, 2**62, 50)
    prints = sorted({int(x) for x in base} | {int(x) ^ (1 << int(b)) ^ (1 << int(c)) for x, b, c in zip(base, rng.randint(0, 63, 50), rng.randint(0, 63, 50), strict=True)} | {-1, -2, 0})
    frame = spark.createDataFrame([(p,) for p in [*prints, 0, None]], "print long")
    apart = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    want = {(a, b, apart(a, b)) for a, b in itertools.combinations(prints, 2) if apart(a, b) <= 3}
    assert {tuple(r) for r in fingerprints.links(frame).collect()} == want


# queries and the pipeline


def test_registered_queries(spark, sf_dir):
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["op2_secret_scans", "op4_line_dedup"])
def test_rows_match_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want, got = con.sql(queries.oracle_sql()[name]).df(), queries.queries()[name](spark, sf_dir).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    columns = sorted(want.columns)
    assert sorted(map(tuple, got[columns].values.tolist()), key=str) == sorted(map(tuple, want[columns].values.tolist()), key=str)


def test_top_k_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = con.sql(queries.OP6_SQL).df().sort_values(["query_id", "rank"])
    got = queries.op6_top_k(spark, sf_dir).toPandas().sort_values(["query_id", "rank"])
    assert got[["query_id", "rank", "vec_id", "score"]].astype("int64").values.tolist() == want[["query_id", "rank", "vec_id", "score"]].astype("int64").values.tolist()


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, many = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), name)
        if name != "packing":
            assert docs.columns == columns
    assert docs.select("doc_id").distinct().count() <= many
    run = corpus_pipeline.run(spark, sf_dir)
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, run.select(key).collect())) == sorted(map(tuple, docs.select(key).collect()))


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, ties, repeated rows and clashing columns; then an empty table."""
    import corpus_pipeline

    folder = str(tmp_path)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    base = [(r.doc_id, r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    shared = "a line of boilerplate on many sites"
    odd = ODD + [(10**9 + 10 + i, f"{shared}\nown words number {i} here", f"s{i % 7}") for i in range(21)] + [(10**9 + 50, "no source at all here", None)]
    full = documents(spark, base + odd).withColumns({"_text": F.lit(1), "_doc": F.lit(None).cast("string"), "nth": F.lit(2)}).withColumn("n_removed", F.lit(3)).withColumn("chance", F.lit(0.5))
    full = full.withColumn("n_chars", F.when(F.col("doc_id") != 10**9, F.col("n_chars"))).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    for frame, label_rows in ((full, labels), (full.limit(0), labels), (full, labels.limit(0))):
        frame.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
        label_rows.write.mode("overwrite").parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        columns, before = docs.columns, docs.count()
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
            if name == "packing":
                break
            assert docs.columns == columns, name
            if name == "line_dedup":
                assert docs.count() == after["quality"]
                if before:
                    assert docs.filter(F.contains("text", F.lit(shared))).count() == 1
            if name == "near_dedup" and before:
                assert docs.filter("coalesce(text, '') = ''").count() <= 1 and docs.filter("text = 'again'").count() <= 1
            after = {name: docs.count()}
        assert (docs.count() == 0) == (before == 0)
        run = corpus_pipeline.run(spark, folder)
        assert run.agg(F.sum("length")).first()[0] == docs.agg(F.sum("length")).first()[0]


def test_scratch_tables_go(spark):
    from sheaf.llm.common import scratch, stored

    with scratch(spark):
        inner = stored(spark.range(3), "inner")
        kept = stored(inner.selectExpr("id + 1 AS id"), "kept", keep=True)
        gone = inner.inputFiles()[0]
    assert kept.count() == 3
    assert not os.path.exists(gone.removeprefix("file://"))
