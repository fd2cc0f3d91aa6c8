import collections
import hashlib
import math
import random
import re
import string

import pytest
from conftest import ODD

from tileflow.llm import secrets


def brute(text):
    """The fixed patterns by their definition."""
    kinds = [
        (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m))


def words(n, seed):
    rng = random.Random(seed)
    parts = ["password", "PassWd", "ſecret", "secret", "token", "api_key", "APIKEY", "=", ": ", "'", '"', " ", "é漢", "AKIA", "AKIA" + "Z9" * 9, "abcdef0123456789", "0123456789abcdefA", "x" * 12, "a.b-c_d/e+f=gh", "\n"]
    return "".join(rng.choice(parts) for _ in range(n))


def random_token(rng, n=48):
    return "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))


def test_base_spans_are_the_patterns():
    for seed in range(500):
        t = words(40, seed)
        assert secrets.base_spans(t, t.encode()) == brute(t)


def test_battery_tells_random_from_written():
    rng = random.Random(5)
    p = [secrets.random_p(random_token(rng)) for _ in range(200)]
    assert sorted(p)[150] < 0.05
    written = ["thecommitteehasdecidedthatthemeeting1", "a" * 30 + "1", "abababababababababababababab12", "src/main/java/org/example/service/Handler2", "0" * 30 + "a", "documentation_page_number_2024_final_version", "internationalization", "12345678901234567890"]
    assert min(map(secrets.random_p, written)) > 0.2
    assert secrets.random_p("+" * 20 + "-") == 1.0
    words = ["chpfheitschverheiten", "anbletitionthtionbletion", "Einungtzheitgeungverlich", "donaudampfschifffahrtsgesellschaft", "electroencephalographically", "UNCHARACTERISTICALLY", "InternationalBusinessMachinesCorporation"]
    assert min(map(secrets.random_p, words)) > 0.2
    letters = sorted(secrets.random_p("".join(rng.choice(string.ascii_letters) for _ in range(48))) for _ in range(100))
    small = sorted(secrets.random_p("".join(rng.choice(string.ascii_lowercase) for _ in range(48))) for _ in range(100))
    assert letters[80] < 1e-6 and small[60] < 1e-3


def test_every_long_run_is_tested_beside_and_inside_base_spans():
    rng = random.Random(3)
    key, hexes = random_token(rng, 40), "".join(rng.choice("0123456789abcdef") for _ in range(40))
    text = f'é api_key = "{key}" and token={hexes}== then {"x" * 19} or {key}.{key}'
    got = [(s, e) for s, e, _, _ in secrets.candidates(text, text.encode())]
    assert [text[s:e] for s, e in got] == [key, hexes + "==", key, key]
    base, every = secrets.spans_of(text.encode(), {k: 1 for k in range(9)})
    assert set(base) < set(every) and sum(k == 3 for _, k, _ in every) == 4
    assert secrets.redactor({k: 1 for k in range(9)})(text.encode()).count(key) == 0
    assert secrets.spans_of(b"\xff\xfe secret=abcdefghijklmn \xe9", {})[0] == [(3, 0, 24)]


def test_work_is_linear_in_the_text():
    import time

    rng = random.Random(2)
    took = []
    for n in (1500, 6000):
        raw = " ".join(f"token={random_token(rng, 24)}" for _ in range(n)).encode()
        began = time.perf_counter()
        secrets.spans_of(raw, {})
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0]


def test_planted_keys_are_found_in_documents(spark, docs):
    """Random keys of 32 to 64 characters, of letters only too, are found at their places; words and plain texts aren't touched."""
    from conftest import ODD

    rng = random.Random(12)
    kinds = [string.ascii_letters + string.digits, string.ascii_letters, "0123456789ABCDEF"]
    rows, places = list(ODD), {}
    for k in range(300):
        filler = " ".join(written_token(rng) for _ in range(6))
        key = "".join(rng.choice(kinds[k % 3]) for _ in range(rng.choice([32, 40, 64]))) if k % 2 else ""
        places[1000 + k] = (len(filler) + 1, len(filler) + 1 + len(key)) if key else None
        rows.append((1000 + k, f"{filler} {key} {filler}"))
    found = wrong = 0
    for r in secrets.scan_documents(spark, docs(rows)).where("doc_id >= 1000").collect():
        spans = {tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("random")}
        found += places[r.doc_id] in spans
        wrong += len(spans - {places[r.doc_id]})
    assert found >= 145 and wrong <= 10


def test_short_tokens_have_little_power():
    rng = random.Random(6)
    short = sorted(secrets.random_p(random_token(rng, 20)) for _ in range(300))[150]
    long = sorted(secrets.random_p(random_token(rng, 96)) for _ in range(300))[150]
    assert long < short / 3


WRITTEN = "the quick committee has decided that meeting page number final version handler service example internal request response http json xml utf cfg query buffer zlib xyz java".split()


def written_token(rng):
    """A path, identifier or dated name of 20 characters or more that has an alphabet."""
    while True:
        w = [rng.choice(WRITTEN) for _ in range(rng.randint(3, 7))]
        t = rng.choice(["".join(x.capitalize() for x in w), "_".join(w) + "_", "/".join(w), "".join(w), "_".join(w).upper() + "_V", "-".join(w) + "-2024-01-", "20240115T1030-" + "-".join(w[:2])]) + str(rng.randint(0, 99))
        if len(t) >= 20 and secrets.encoding_of(t):
            return t


def grid_step(token):
    return min(secrets.LAST_STEP, int(-math.log10(max(secrets.random_p(token), 1e-300)) * secrets.STEPS))


@pytest.mark.parametrize(("n", "share", "least"), [(20, 0.1, 0.75), (24, 0.1, 0.85), (32, 0.1, 0.9), (40, 0.1, 0.9), (20, 0.01, 0.6), (24, 0.01, 0.75), (32, 0.01, 0.85), (40, 0.01, 0.9)])
def test_short_keys_are_found_among_written_tokens(n, share, least):
    rng = random.Random(n)
    rest = [grid_step(written_token(rng)) for _ in range(4000)]
    for alphabet in (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits):
        keys = [grid_step("".join(rng.choice(alphabet) for _ in range(n))) for _ in range(int(len(rest) * share))]
        counts = collections.Counter((0, s) for s in rest + keys)
        first = secrets.thresholds(counts, {0: len(rest) + len(keys)})[0]
        found, wrong = sum(s >= first for s in keys), sum(s >= first for s in rest)
        assert found >= least * len(keys)
        assert wrong <= 0.05 * (found + wrong) + 1


def test_written_tokens_alone_give_no_discovery():
    rng = random.Random(11)
    steps = [grid_step(written_token(rng)) for _ in range(4000)]
    assert secrets.thresholds(collections.Counter((0, s) for s in steps), {0: len(steps)}) == {}


def test_step_up():
    # 10 tests: p <= 10**-2 for three of them, the rest 1
    counts = {(1, 2 * secrets.STEPS): 3, (1, 0): 7}
    first = secrets.thresholds(counts, {1: 10}, 0.05)[1]
    assert 10 ** (-first / secrets.STEPS) <= 0.05 * 3 / 10 < 10 ** (-(first - 1) / secrets.STEPS) * 1.01
    assert secrets.thresholds({(1, secrets.STEPS): 1, (1, 0): 9}, {1: 10}, 0.05) == {}
    assert secrets.thresholds({}, {}) == {}


def test_scan_and_redaction(spark, docs):
    rng = random.Random(7)
    rows = ODD + [(100 + k, f"some words {random_token(rng, 64)} and more") for k in range(40)] + [(300 + k, words(30, k)) for k in range(60)] + [(500, "plain text about internationalization, 2024")]
    table = docs(rows, extra=True)
    out = secrets.scan_documents(spark, table).collect()
    assert len(out) == len(rows)
    texts = dict(rows)
    found = 0
    for r in out:
        if r.doc_id is None or r.doc_id in (4, 5):
            continue
        base = brute(texts[r.doc_id] or "")
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
        named = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        assert set(filter(None, named.split(","))) <= set(filter(None, r.spans.split(",")))
        found += r.n_random > 0 and 100 <= r.doc_id < 140
        assert r.doc_id != 500 or r.spans == ""
    assert found >= 36
    redacted = {r.doc_id: r for r in secrets.redact_documents(spark, table.withColumn("n_chars", table.doc_id)).collect()}
    assert redacted[500].text == texts[500] and redacted[1].text is None
    assert all(not brute(redacted[300 + k].text) for k in range(60))
    assert all(r.text is None or r.n_chars == len(r.text) for r in redacted.values())
    assert secrets.scan_documents(spark, docs([])).count() == 0
