import hashlib
import random
import re

from candrank.llm.registry import QUERIES
from candrank.llm.secrets import KINDS, BatteryParams, Ordinary, battery, neighbours, p_value, redact, secret_spans
from tests.conftest import DATA
from tests.llm.edge import ROWS, documents


def plain(text):
    """The fixed patterns again, each as one search for the leftmost match after the last."""
    kinds = {
        0: (r"""(?ai:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)(?P<v>[A-Za-z0-9+/_.=-]+)""", 6),
        1: (r"(?P<v>AKIA[A-Z0-9]+)", 20), 2: (r"(?P<v>[0-9a-f]+)", 24),
    }
    out = []
    for k, (p, least) in kinds.items():
        at = 0
        while m := re.compile(p).search(text or "", at):
            at = m.end()
            if len(m["v"]) >= least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_query_on_documents(spark):
    texts = dict(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    for r in QUERIES["op2_secret_scan"](spark, DATA).collect():
        base = plain(texts[r.doc_id])
        written = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in base) for x in range(3)]
        assert set(written.split(",")) <= set(r.spans.split(","))


CORPUS = "It was the best of times and internationalization of the names in some ordinary words, 2019 of them. The quick brown fox jumps over it. " * 40
B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def p_of(s, model=Ordinary.learn(neighbours(CORPUS), 0.1), params=BatteryParams()):
    r = battery(s)
    return 1.0 if r is None else p_value(s, *r, model, params)


def test_battery_tells_random_from_ordinary():
    rnd = random.Random(2)
    p = [p_of("".join(rnd.choice(B64) for _ in range(40))) for _ in range(200)]
    assert sum(x < 1e-6 for x in p) > 180
    words = ("internationalization2", "aaaaaaaaaaaaaaaaaaaaaaa1", "abababababababababab12", "thequickbrownfoxjumps9over", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "1" * 30, "4952935900253052", "THE_QUICK_BROWN_FOX_JUMPS", "getNamesOfOrdinaryWordsInTimes")
    assert all(p_of(w) > 1e-3 for w in words)


def test_counts_of_neighbours_and_pieces(monkeypatch):
    import candrank.llm.secrets as module

    text = "Ab1_é" * 50 + "A1b2c3d4e5f6g7h8i9 k"
    want = {}
    for x, y in zip(text.replace("A1b2c3d4e5f6g7h8i9", "....."), text.replace("A1b2c3d4e5f6g7h8i9", ".....")[1:]):
        fold = lambda c: 31 if ord(c) > 127 or c in ". " else "abcdefghijklmnopqrstuvwxyz".index(c.lower()) if c.isalpha() else 26 if c.isdigit() else 29
        want[fold(x), fold(y)] = want.get((fold(x), fold(y)), 0) + 1
    for piece in (7, 1 << 20):
        monkeypatch.setattr(module, "PIECE", piece)
        got = neighbours(text)[:1024].reshape(32, 32)
        got[31, 31], want[31, 31] = 0, 0
        assert {(i, j): got[i, j] for i, j in zip(*got.nonzero())} == {k: v for k, v in want.items() if v}


def test_keys_at_realistic_prevalence(spark):
    """One key of 20 to 40 characters in a thousand strings: recall, and false discoveries among strings built of the corpus's own words."""
    rnd = random.Random(8)
    lower = "abcdefghijklmnopqrstuvwxyz0123456789"
    words = sorted({w for t, in spark.read.parquet(f"{DATA}/documents.parquet").select("text").where("text IS NOT NULL").collect() for w in re.findall("[A-Za-z]{3,}", t)})

    def name():
        parts = [rnd.choice(words) for _ in range(rnd.randint(3, 6))]
        s = rnd.choice([lambda: "_".join(parts).lower(), lambda: "-".join(parts), lambda: "".join(w.capitalize() for w in parts), lambda: "_".join(parts).upper(), lambda: "".join(parts).lower()])()
        return s + (str(rnd.randrange(10 ** rnd.randint(1, 6))) if rnd.random() < 0.5 else "")

    def key():
        n = rnd.randint(20, 40)
        return "".join(rnd.choice(B64) for _ in range(n)) if rnd.random() < 0.6 else "".join(rnd.choice(lower) for _ in range(n))

    keys = [key() for _ in range(60)]
    rows = [(i, " ".join([*(name() for _ in range(500)), k, *(name() for _ in range(500))]), "en", "s") for i, k in enumerate(keys)]
    prose = spark.read.parquet(f"{DATA}/documents.parquet").where("text IS NOT NULL").select("text").collect()
    rows += [(1000 + i, r.text, "en", "s") for i, r in enumerate(prose)]
    docs = documents(spark, rows)
    found = right = wrong = 0
    for r in secret_spans(docs).where("doc_id < 1000").collect():
        got = {rows[r.doc_id][1][s.start : s.end] for s in r.spans if s.kind == 3}
        right += keys[r.doc_id] in got
        wrong += len(got - {keys[r.doc_id]})
        found += len(got)
    print(f"recall {right / 60:.3f}, false discoveries {wrong} of {found}, {60 * 1000} other strings")
    assert right >= 54 and wrong <= 0.05 * found


def test_added_spans_against_a_plain_count(spark):
    """The threshold and the spans again, from all p-values sorted, not from a histogram."""
    rnd = random.Random(12)
    rows = [(i, f"{CORPUS[:300]} {''.join(rnd.choice(B64) for _ in range(rnd.randint(16, 50)))} password: hunter2hunter2 {rnd.choice(['some_ordinary_words', 'internationalization', 'Best0fTimes0fNames'])}", "en", "s") for i in range(80)]
    params = BatteryParams()
    model = Ordinary.learn(sum(neighbours(t) for _, t, *_ in rows), params.floor)
    every = {}
    for i, t, *_ in rows:
        for m in re.finditer("[A-Za-z0-9+/_-]+", t):
            if len(m[0]) >= 16 and not any(a < m.end() and m.start() < b for a, _, b in plain(t)) and (r := battery(m[0])):
                every[i, m.start(), m.end()] = p_value(m[0], *r, model, params)
    most = max((p for n, p in enumerate(sorted(every.values()), 1) if p <= params.fdr * n / len(every)), default=0.0)
    want = {k for k, p in every.items() if p <= most}
    got = {(r.doc_id, s.start, s.end) for r in secret_spans(documents(spark, rows)).collect() for s in r.spans if s.kind == 3}
    assert len(want) > 40 and got <= want and len(want - got) <= 2  # bins round thresholds down


def test_planted_random_strings_are_found(spark):
    rnd = random.Random(4)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows = [(i, f"see {''.join(rnd.choice(chars) for _ in range(44))} end", "en", "s") for i in range(40)] + [(100 + i, "ordinary words_with_number12 and internationalization" * 3, "en", "s") for i in range(40)]
    got = {r.doc_id: r.spans for r in secret_spans(documents(spark, rows)).collect()}
    assert sum(bool(got[i]) for i in range(40)) >= 32 and not any(got[100 + i] for i in range(40))


def test_keys_of_any_length_are_found_and_redacted(spark):
    rnd = random.Random(5)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rnd.choice(chars) for _ in range(n)) for n in (512, 513, 2000, 50_000) for _ in range(10)]
    docs = documents(spark, [(i, f"see {k} end", "en", "s") for i, k in enumerate(keys)] + [(900, "thequickbrownfoxjumps9over" * 100, "en", "s")])
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_spans(docs).collect()}
    texts = {r.doc_id: r.text for r in redact(docs).collect()}
    for at in range(0, len(keys), 10):  # each test refuses a hundredth of random strings
        hit = [i for i in range(at, at + 10) if got[i] == [(4, 3, 4 + len(keys[i]))]]
        assert len(hit) >= 8 and all(texts[i] == "see [SECRET] end" for i in hit)
    assert got[900] == []


def test_edge_rows_and_redaction(spark):
    got = sorted((r.doc_id or -1, len(r.spans)) for r in secret_spans(documents(spark)).collect())
    assert got == sorted((i or -1, len(plain(t))) for i, t, *_ in ROWS)
    clean = redact(documents(spark))
    assert clean.columns == documents(spark).columns
    texts = sorted((str(r.doc_id), str(r.text)) for r in clean.collect())
    assert texts == sorted((str(i), str(t).replace("password: hunter2hunter2", "[SECRET]")) for i, t, *_ in ROWS)
    assert secret_spans(documents(spark, [])).count() == 0 and redact(documents(spark, [])).count() == 0
