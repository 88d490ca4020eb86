import hashlib
import random
import re

import pytest

from glossaleaf.llm import secrets
from glossaleaf.llm.queries import op2_secrets

ID = "login: jdoe"
HOST = "https://db.example.org/x"


def base_spans(text):
    """The strong kinds, by the words of their definition."""
    found = []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 18:
            found.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 16:
            found.append((m.start(), 2, m.end(), "hex"))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def kinds(text, **options):
    return [k for k, _, _ in secrets.spans_of(text, **options)]


def test_strong_kinds():
    assert kinds("password = abcdefghijkl") == ["assign"]
    assert kinds('API_KEY": "abc/def+ghi=x') == ["assign"]
    assert kinds("paſſword = abcdefghijkl") == []  # only ASCII letters have two cases
    assert kinds("AKIA" + "A1" * 7) == ["access"]
    assert kinds("0123456789abcdef") == ["hex"]
    # a dropped match has used up its text
    assert kinds("secret:token = abcdefghijklmn") == []


def test_positions_count_code_points():
    assert secrets.spans_of("é\U0001f600 token=abcdefghijkl") == [("assign", 3, 21)]


@pytest.mark.parametrize(
    "text, found",
    [
        ("password = hunter2", []),
        (f"password = hunter2 {ID}", ["short_assign", "named_id"]),
        (f"password = hunter2 {HOST}", ["short_assign"]),
        (f"{ID} {HOST}", []),
        (f"{ID} password = hunter2 {HOST}", ["named_id", "short_assign", "endpoint"]),
        (f"{ID}\n\npassword = hunter2", []),
        (f"{ID}\npassword = hunter2", ["named_id", "short_assign"]),
        (f"{ID}{' ' * 3000}password = hunter2", ["named_id", "short_assign"]),
        (f"{ID}\n{'word ' * 400}\npassword = hunter2", ["named_id", "short_assign"]),
        (f"{ID}\n{'word ' * 400}\n \npassword = hunter2", []),
        ("AKIA12345678 token=abcdefghijkl", ["short_access", "assign"]),
        ("AKIA" + "A1" * 7 + " deadbeef99", ["access", "short_hex"]),
        ("AKIA" + "A1" * 7 + " Ab3" + "x" * 20, ["access", "opaque"]),
    ],
)
def test_weak_candidates_need_their_complement(text, found):
    assert kinds(text) == found


OPAQUE = "Ab3" + "x" * 20


@pytest.mark.parametrize(
    "text, found",
    [
        (f"{HOST}?user=jdoe&password=hunter2", ["endpoint", "named_id", "short_assign"]),
        (f"{HOST}?user=jdoe&password=abcdefghijkl", ["endpoint", "named_id", "assign"]),
        (f"login: {OPAQUE} {HOST}", ["opaque", "endpoint"]),
        (f"login: {OPAQUE}", []),  # one value is not both parts
        (f"https://db.example.org/{OPAQUE}", []),
    ],
)
def test_a_part_that_is_not_reported_hides_no_other(text, found):
    assert kinds(text) == found


def test_reach_is_an_option():
    assert kinds(f"{ID}{' ' * 300}password = hunter2", reach=200) == []
    assert kinds(f"{ID}{' ' * 150}password = hunter2", reach=200) == ["named_id", "short_assign"]


def all_pairs(text):
    """By the definition: every part is held against every other of its scope; overlaps come last."""
    strong, weak = secrets.strong_and_short(text)
    weak += [("named_id", *m.span()) for m in secrets.NAMED_ID.finditer(text)]
    named = [a for k, a, _ in strong + weak if k in ("assign", "access", "short_assign", "named_id")]
    weak += [("opaque", *m.span()) for m in secrets.OPAQUE.finditer(text) if secrets._is_opaque(m[0])]
    for m in secrets.ENDPOINT.finditer(text):
        inside = [a for a in named if m.start() < a < m.end()]
        end = m.end() if not inside else m.start() + len(text[m.start() : min(inside)].rstrip("?&;#,"))
        weak.append(("endpoint", m.start(), end))
    weak = [w for w in weak if not any(a < w[2] and b > w[1] for _, a, b in strong)]
    breaks = [m.start() for m in re.finditer(r"\n[\x20\t\r]*\n", text)]

    def near(part, role):
        scope = sum(b <= part[1] for b in breaks)
        return any(
            secrets.ROLE[k] == role and sum(x <= a for x in breaks) == scope and (b <= part[1] or a >= part[2]) for k, a, b in strong + weak
        )

    needs = {"identifier": ["secret"], "secret": [], "endpoint": ["identifier", "secret"]}
    linked = [
        w for w in weak
        if all(near(w, r) for r in needs[secrets.ROLE[w[0]]]) and (secrets.ROLE[w[0]] != "secret" or near(w, "identifier") or near(w, "endpoint"))
    ]
    out = []
    for w in sorted(linked, key=lambda w: (w[1], -w[2], secrets.ORDER[w[0]])):
        if all(v[2] <= w[1] for v in out):
            out.append(w)
    return sorted(strong + out, key=lambda w: (w[1], secrets.ORDER[w[0]], w[2]))


def test_against_all_pairs():
    rng = random.Random(4)
    pieces = [ID, HOST, "password = hunter2", "deadbeef99", "AKIA1234567", "token=abcdefghijkl", "10.0.0.1:80", "\n\n", "\n", "word " * 20, "Zz9" + "k" * 22]
    pieces += [f"{HOST}?user=jdoe&password=hunter2", f"{HOST}/Zz9{'k' * 22}", "https://10.0.0.1/?token=abcdefghijklm", "redis://h/#login=bob;x"]
    reported = 0
    for _ in range(600):
        text = rng.choice(["", " "]).join(rng.choice(pieces) + rng.choice([" ", "", "\n"]) for _ in range(rng.randrange(1, 20)))
        assert secrets.spans_of(text) == all_pairs(text), text
        reported += len(secrets.spans_of(text)) - len(secrets.strong_and_short(text)[0])
    assert reported > 1000


def test_split_credentials_in_a_table(spark):
    """Parts that mean nothing alone, spread over a block of settings; nothing of it is a base span."""
    filler = "\n".join(f"setting_{i}: some plain words" for i in range(40))
    split = f"host: db.internal.example\nurl: postgres://db.example.org/main\n{filler}\nuser: reporting\n{filler}\npassword: hunter2x"
    rows = [(1, split), (2, split.replace("password: hunter2x", "nothing here")), (3, split.replace(filler, "\n\n")), (4, None)]
    got = {r.doc_id: [s["kind"] for s in r.spans] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["endpoint", "named_id", "short_assign"], 2: [], 3: [], 4: []}


def test_many_parts_in_one_scope():
    text = " ".join([ID, "password = hunter2", HOST] * 20_000)
    assert len(secrets.spans_of(text)) == 60_000


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op2_secrets(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
        assert set(want) <= set(r.spans.split(","))


def test_messy_and_empty(messy, messy_rows, empty):
    key = lambda r: tuple((x is None, x) for x in r)
    got = [(r.doc_id, [tuple(s) for s in r.spans]) for r in secrets.scan(messy).collect()]
    assert sorted(got, key=key) == sorted([(r[0], all_pairs(r[1] or "")) for r in messy_rows], key=key)
    assert secrets.scan(empty).count() == 0
