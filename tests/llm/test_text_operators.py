"""Operators over documents against brute force, with the awkward rows of the fixtures."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysieve.llm import decontamination, jaccard_join, mixing, secret_scan, substring_dedup, token_counts, toxicity
from skysieve.llm.common import Scratch


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# --- secrets ---------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


CASES = [
    'Password = "abcdefghijkl"', "token: secret: abcdefghijklmnop", "token=secret=abcdefghijkl", "api_key='short'", "AKIA1234567890ABCD AKIAAKIA12", "é AKIA1234567890ABCDE",
    "deadbeefdeadbeef 0123456789abcdefg", "toKen=abcdefghijklmnop", "paſsword=abcdefghijklmnop", "secret:\n abcdefghijklmnop", "", None,
]


@pytest.mark.parametrize("text", CASES)
def test_base_spans(text):
    assert [s for s in secret_scan.spans_of(text) if s[1] < 3] == plain_spans(text or "")


def test_novel_spans_are_incompressible():
    key = "q9Zx7LmPf2Vb8TnRk4Ws"
    text = f"the credential is {key} here"
    assert (text.index(key), 3, text.index(key) + len(key)) in secret_scan.spans_of(text)
    assert not [s for s in secret_scan.spans_of("the credential is aaaaaaaaaaaaaaaaaaaaaaaaaaaa here") if s[1] == 3]
    assert not [s for s in secret_scan.spans_of(f"nothing of note {key} here") if s[1] == 3]


@pytest.mark.parametrize("name", [*secret_scan.CONTEXT_NAMES, "private_key", "client_id.v2", "AUTH_HEADER"])
@pytest.mark.parametrize("form", ["{}={}", "export {}={}\n", "{} = {}", "{} ={}", "{}='{}'", "{}: {}", "https://h.example/x?{}={}&x=1", "Server=h;{}={};Pool=1"])
def test_name_value_is_covered(name, form):
    key = "kJ8s9dKs0dkLs82kslOq91"
    text = form.format(name, key)
    at = text.index(key)
    assert [s for s in secret_scan.spans_of(text) if s[0] <= at and at + len(key) <= s[2]]


def test_name_value_spans():
    one, two = "kJ8s9dKs0dkLs82kslOq91", "Zt5Rw0Yb3Nq8Xc6V"
    spans = lambda text: [text[a:b] for a, k, b in secret_scan.spans_of(text) if k == 3]
    assert spans(f"pwd={one}") == [one]
    assert spans(f"?client_id={one}&signature={two}&x") in ([one, two], [one, f"signature={two}"])
    assert spans(f"auth=pwd={two} b") in ([two], [f"pwd={two}"])
    assert spans(f"client_id={one}.token={two}") == [f"{one}."]
    assert spans("pwd=aaaaaaaaaaaaaaaaaaaaaaaaaaaa") == spans("auth=authorization_connection_string") == spans(f"note={one}") == []


def test_scan_and_redact(spark, documents, empty):
    out = rows_of(secret_scan.scan_secrets(documents, redact="[x]"))
    want = Counter((r.doc_id, tuple(plain_spans(r.text or ""))) for r in documents.collect())
    kinds = secret_scan.KINDS
    assert Counter((r["doc_id"], tuple((s["start"], kinds.index(s["kind"]), s["end"]) for s in r["spans"])) for r in out) == want
    df = spark.createDataFrame([(1, 'a password: "abcdefghijklmnopqrs" b'), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["redacted"] for r in rows_of(secret_scan.scan_secrets(df, redact="[x]"))}
    assert got == {1: 'a [x]" b', 2: None}
    assert secret_scan.scan_secrets(empty).count() == 0


# --- decontamination -------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(AZ))


def test_decontamination(spark, documents, texts, empty):
    long_item = " ".join(texts[12].split()[5:30])
    items = [(1, long_item), (2, "One two"), (3, "..."), (4, None), (5, texts[20].upper()), (None, " ".join(texts[3].split()[:10])), (1, "é" * 450)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add("" if i is None else str(i))
    want = Counter()
    for r in documents.select("doc_id", "text").collect():
        w, hit, its = words(r.text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k : k + size])) in windows:
                    hit.update(range(k, k + size))
                    its |= windows[x]
        want[(r.doc_id, len(w), len(hit), tuple(sorted(its)))] += 1
    for part in (100_000, 5):  # one automaton, and several in turn
        out = rows_of(decontamination.decontaminate(documents, bench, part_windows=part))
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in out) == want
    by_id = {r.doc_id: r.text for r in documents.collect()}
    for r in out:
        if r["doc_id"] is not None:
            assert sum(len(words(by_id[r["doc_id"]][s["start"] : s["end"]])) for s in r["spans"]) == r["n_hit"]
    assert decontamination.decontaminate(empty, bench).count() == 0
    assert {r["n_hit"] for r in rows_of(decontamination.decontaminate(documents, bench.limit(0)))} == {0}


# --- token counts ----------------------------------------------------------------------------------------------------


def test_token_counts(spark, documents, empty):
    tokenizers = pytest.importorskip("tokenizers")
    files = pytest.importorskip("public_tokenizers")
    path = files.path("word_bpe_49k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    odd = ["a<|endoftext|>b don't  I'LL x ́ éa 中文字 ½ 12345 \U0001f600　\xa0", "\x00 \x1c \x85 x", "ΣΑΣ"]
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(900 + k, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    want = Counter((r.doc_id, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
    for head in (token_counts.HEAD, 40, 0):  # the whole dictionary in the tasks, its head, nothing of it
        got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows_of(token_counts.count_tokens(df, path, head=head)))
        assert got == want
    assert token_counts.count_tokens(empty, path).count() == 0


def test_dictionary_counts_each_pre_token_once(spark, documents, tmp_path):
    pytest.importorskip("tokenizers")
    files = pytest.importorskip("public_tokenizers")
    scratch = Scratch(spark, "dictionary")
    cuts = token_counts.distinct_cuts(documents.select(F.col("text").cast("binary")))
    want = Counter(c for r in documents.collect() for c in set((r.text or "").encode().split()))
    assert {bytes(r["cut"]): r["n"] for r in rows_of(cuts)} == want
    words = token_counts.dictionary(cuts, files.path("word_bpe_49k.json"), scratch)
    assert words.count() == len(want)
    counted = spark.read.parquet(f"{scratch.root}/*-words")
    assert counted.count() == counted.select("word").distinct().count() > 0


# --- Jaccard join ----------------------------------------------------------------------------------------------------


def brute_components(rows, size=5):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            groups[find(k)].append(i)
    return Counter((i, len(sets[k]), (min(groups[find(k)]) if groups[find(k)] else None) if sets[k] else i) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("how", [{}, {"cold": 2, "chunk": 3}, {"cold": 3, "locally_hot": 2, "chunk": 2}])
def test_jaccard_components(documents, how):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(jaccard_join.join_components(documents, **how)))
    assert got == brute_components(rows)


@pytest.mark.parametrize("how", [{}, {"block": 1}, {"cold": 2, "chunk": 3, "block": 3}])
def test_jaccard_links(spark, documents, how):
    """Each document's links are all counted, also inside a group of near copies with different texts."""
    base = [f"n{k}" for k in range(100)]
    near = [(1000 + k, " ".join([*base[: 3 * k], *(f"x{k}_{j}" for j in range(k % 4)), *base[3 * k + 1 :]])) for k in range(12)]
    near += [(2000 + k, " ".join(base[: 100 - 4 * k])) for k in range(15)]  # a chain whose ends do not link
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame([*near, near[0]], "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    sets = [frozenset(jaccard_join.shingles(t).tolist()) for _, t in rows]
    linked = lambda a, b: bool(a) and 5 * len(a & b) >= 4 * len(a | b)
    want = Counter((i, len(a), sum(linked(a, b) for b in sets) - bool(a)) for (i, _), a in zip(rows, sets, strict=True))
    assert Counter((r["doc_id"], r["n_shingles"], r["n_links"]) for r in rows_of(jaccard_join.join_components(df, **how))) == want
    assert max(n for _, _, n in want) > 10


def test_jaccard_hot_bucket_of_unlike_texts(spark):
    """Long texts that share most of their words' ranges, but not enough to link: a hot bucket whose pairs are all ruled out in the task."""
    rng = np.random.default_rng(9)
    common = [f"c{k}" for k in range(700)]
    rows = [(k, " ".join([*common, *(f"u{k}_{j}" for j in range(int(rng.integers(280, 330))))])) for k in range(300)]
    rows += [(1000 + k, rows[k][1] + " tail") for k in range(3)]
    got = {r["doc_id"]: r for r in rows_of(jaccard_join.join_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), cold=8))}
    assert {i: r["component_id"] for i, r in got.items()} == {i: i - 1000 if i >= 1000 else i for i, _ in rows}
    assert {i: r["n_links"] for i, r in got.items()} == {i: int(i >= 1000 or i < 3) for i, _ in rows}


def test_jaccard_kernel_against_brute_force():
    """Counts and components of many sets at once, in strips, from a base, and across two blocks."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = []
    for _ in range(90):
        drop, add = int(rng.integers(0, 9)), int(rng.integers(0, 9))
        pool = rng.integers(0, 40, add).astype(np.uint64)  # elements that some sets share
        sets.append(np.unique(np.concatenate([rng.permutation(base)[drop:], pool])))
    n, copies = np.array([len(s) for s in sets]), rng.integers(1, 5, len(sets))
    have = [set(s.tolist()) for s in sets]
    linked = np.array([[5 * len(a & b) >= 4 * len(a | b) for b in have] for a in have])
    np.fill_diagonal(linked, False)
    assert linked.any() and not linked[~np.eye(len(sets), dtype=bool)].all()

    def reached(m):
        root = np.arange(len(m))
        for _ in range(len(m)):
            root = np.array([min(root[k], *root[m[k]]) if m[k].any() else root[k] for k in range(len(m))])
        return root

    for made in (sets, [np.setxor1d(s, sets[7]) for s in sets]):
        links, root = jaccard_join.links_of(made, n, copies, (4, 5))
        assert links.tolist() == (linked @ copies).tolist() and root.tolist() == reached(linked).tolist()
        across = linked.copy()
        across[:40, :40] = across[40:, 40:] = False
        links, root = jaccard_join.links_of(made, n, copies, (4, 5), split=40)
        assert links.tolist() == (across @ copies).tolist() and root.tolist() == reached(across).tolist()


def test_jaccard_sketches_fold():
    a, b = (np.unique(np.random.default_rng(k).integers(0, 2**63, n).astype(np.uint64)) for k, n in ((1, 300), (2, 250)))
    assert len(jaccard_join.sketch(a)) == 128 and len(jaccard_join.sketch(b)) == 64
    long, short = jaccard_join._folded([jaccard_join.sketch(a), jaccard_join.sketch(b)])
    bits = lambda h: (np.bincount((h & np.uint64(511)).astype(np.int64), minlength=512) & 1).astype(np.uint8)
    assert long.tobytes() == np.packbits(bits(a)).tobytes() and short.tobytes() == np.packbits(bits(b)).tobytes()


def test_jaccard_empty(empty):
    assert jaccard_join.join_components(empty).count() == 0


def test_signatures_lose_no_similar_pair():
    """Sets at the limit of similarity share a signature, whatever their sizes and bands."""
    rng = np.random.default_rng(7)
    for _ in range(400):
        n = int(rng.integers(4, 120))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        drop, add = int(rng.integers(0, n // 5 + 1)), 0
        while (n - drop) * 5 >= 4 * (n + add + 1):
            add += 1
        b = np.concatenate([a[drop:], rng.integers(0, 2**63, add).astype(np.uint64)])
        if (n - drop) * 5 < 4 * (n + add) or not len(b):
            continue
        x, y = (np.concatenate([s for s, _, _ in jaccard_join.signatures(np.unique(v), (4, 5))]) >> np.uint64(1) for v in (a, b))
        assert len(np.intersect1d(x, y)), (n, drop, add)


# --- substring removal -----------------------------------------------------------------------------------------------


def brute_removal(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                mark[k : k + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        runs = sum(1 for k in range(len(mark)) if mark[k] and (k == 0 or not mark[k - 1]))
        out[(i, len(b), sum(mark), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("how", [{}, {"locally_hot": 1, "hot": 1}])
def test_substring_removal(documents, how):
    rows = [(r.doc_id, r.text if r.text is None or len(r.text) < 50_000 else None) for r in documents.collect()]
    df = documents.sparkSession.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = rows_of(substring_dedup.dedup_substrings(df, **how))
    got = Counter((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), r["kept_sha256"]) for r in out)
    assert got == brute_removal(rows, 400)


def test_substring_removal_with_many_repeated_rows(spark):
    """Rows that repeat id and text are copies of each other, and one of them stands for all as a partner of others."""
    rng = np.random.default_rng(21)
    word = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(n))
    passage = word(65)[:450]
    rows = [(k, f"{word(30)} {passage} {word(30)}") for k in range(30)]
    repeated = spark.range(8000).select(F.lit(0).cast("long").alias("doc_id"), F.lit(rows[0][1]).alias("text"))
    df = spark.createDataFrame(rows[1:] + [(None, "n" + rows[5][1]), (None, "n" + rows[5][1])], "doc_id long, text string").unionByName(repeated).repartition(4)
    out = rows_of(substring_dedup.dedup_substrings(df))
    assert len(out) == 8031
    for r in out:
        removed = sum(s["end"] - s["start"] for s in r["spans"])
        if r["doc_id"] in (0, None):
            assert removed == r["n_bytes"]
        elif r["doc_id"] != 5:
            assert 450 <= removed <= 460, r


def test_suffix_array_refuses_what_it_cannot_pack():
    with pytest.raises(ValueError):
        substring_dedup.suffix_array(np.zeros(1 << 21, np.uint8))


def test_run_length_index_holds_runs():
    text = np.frombuffer(b"abracadabra" * 50 + b"\xff", np.uint8)
    index = substring_dedup.RunLengthIndex(text)
    assert int(index.lengths.sum()) == len(text) and len(index.heads) < len(text) // 10
    data = text.tobytes()
    stats = index.statistics()
    for at in (0, 5, 300, 540, 550):
        longest = max((n for n in range(len(data) - at + 1) if data.find(data[at : at + n]) not in (at, -1) or data.find(data[at : at + n], at + 1) >= 0), default=0)
        assert stats[at] == longest


def test_substring_empty(empty):
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_index_against_brute_force():
    rng = np.random.default_rng(11)
    base = bytes(rng.integers(97, 101, 2000).astype(np.uint8))
    pieces = list(dict.fromkeys(base[a : a + n] for a, n in zip(rng.integers(0, 1200, 40).tolist(), rng.integers(60, 700, 40).tolist(), strict=True)))
    seen = Counter(p[k : k + 50] for p in pieces for k in range(len(p) - 49))
    for p, runs in zip(pieces, substring_dedup.index_marks(pieces, 50), strict=True):
        assert {k for a, b in runs for k in range(a, b)} == {k for k in range(len(p) - 49) if seen[p[k : k + 50]] > 1}


# --- toxicity --------------------------------------------------------------------------------------------------------


def test_toxicity_learns_and_folds(spark):
    import random

    rng = random.Random(3)
    plain = ["tree", "house", "river", "stone", "cloud", "grass", "light", "water"]
    rows, labels = [], []
    for k in range(600):
        w = [rng.choice(plain) for _ in range(30)]
        toxic = k % 5 == 0
        if toxic:
            w[3] = w[9] = "vilest"
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in rows_of(toxicity.score(docs, lexicon))}
    held = [k for k in got if got[k]["held_out"]]
    assert held and all(zlib.crc32(str(k).encode()) % 5 == 0 for k in held)
    assert all(got[k]["predicted"] == dict(labels)[k] for k in got)
    assert lexicon.score("river v1l3st stone vіlest " + "tree " * 20) > 0.5 > lexicon.score("river stone")


def test_toxicity_scores_as_a_plain_loop_does():
    """The automaton's matches, exceptions and score against a search of each word."""
    lexicon = toxicity.Lexicon({" vil": 1.5, " vile ": 2.0, " gor": 1.0}, frozenset({"gore tex", "of vile"}), (-1.0, 0.5, 0.25, 0.1))
    for text in ["V1le gore, of vile. gore tex gorey", "", None, "vіlest tree", "gore", "a " * 500 + "vile", "of vile of vile vile"]:
        words = toxicity.fold(text).split()
        total = 0.0
        for k, w in enumerate(words):
            marked, near = f" {w} ", {f"{words[k - 1]} {w}" if k else "", f"{w} {words[k + 1]}" if k + 1 < len(words) else ""}
            fits = [v for e, v in lexicon.weights.items() if marked.startswith(e)]
            total += max(fits) if fits and not near & lexicon.exceptions else 0
        x = [1.0, np.log1p(total), np.log1p(100 * total / max(1, len(words))), np.log1p(len(words)) / 5]
        assert abs(lexicon.score(text) - 1 / (1 + np.exp(-np.dot(x, lexicon.curve)))) < 1e-12


def test_toxicity_awkward(spark, documents, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = rows_of(toxicity.score(documents, toxicity.fit(documents, none)))
    assert len(out) == documents.count() and {r["predicted"] for r in out} == {0} and all(0 <= r["score"] <= 1 for r in out)
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    assert toxicity.score(documents, toxicity.fit(documents, odd)).count() == documents.count()
    assert toxicity.score(empty, toxicity.fit(empty, none)).count() == 0


# --- mixing ----------------------------------------------------------------------------------------------------------


def test_mixing(spark, documents, empty):
    out = rows_of(mixing.mix(documents))
    again = rows_of(mixing.mix(documents.repartition(7)))
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["size"], r["taken"])
    assert sorted(out, key=key) == sorted(again, key=key) and len(out) == documents.count()
    source = Counter()
    for r in documents.collect():
        source[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert {r["source_size"] for r in out} == set(source.values())
    assert all(r["taken"] <= 3 * r["size"] for r in out)
    by = {r["source_size"]: r["target"] for r in out}
    assert abs(sum(by.values()) - sum(source.values())) < 1e-6 * sum(source.values())
    assert all(t <= 3 * s + 1e-9 for s, t in by.items())
    assert mixing.mix(empty).count() == 0


def test_mixing_meets_targets(spark):
    rows = [(k, "w " * (1 + k * 37 % 90), f"s{k % 5 if k % 3 else 0}") for k in range(3000)]
    out = rows_of(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    taken, target = Counter(), {}
    for r in out:
        taken[r["source_size"]] += r["taken"]
        target[r["source_size"]] = r["target"]
    assert all(abs(taken[s] - t) <= 90 for s, t in target.items())


def test_mixing_shares_the_excess(spark):
    rows = [(1, "a " * 10, "a"), (2, "b " * 1000, "b"), (3, "c " * 10, None)]
    got = {r["doc_id"]: r for r in rows_of(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")))}
    assert got[1]["target"] == 30 and got[3]["target"] == 30 and got[2]["target"] == 960 and got[1]["taken"] == 30
