import hashlib
import random
import re
import string

from lenscube.llm import secrets

BASE = (
    ("assign", re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[1]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def brute(text):
    spans = [(m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(BASE) for m in p.finditer(text or "") if ok(m)]
    return sorted(spans)


def listed(spans):
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)


def test_base_spans_equal_brute_force(spark):
    r = random.Random(7)
    pieces = ["Token", "secret=", "api_key: ", "token", "=", ":", '"', "'", " ", "AKIA", "AKIA" + "Z9" * 9, "0f" * 14, "é𝄞", "abcdef", "x.y", "\n", "PASSWD = 'a1B2c3d4'", "apikey"]
    rows = [(i, "".join(r.choice(pieces) for _ in range(r.randint(0, 25))), "hex") for i in range(400)]
    rows += [(900, None, "a"), (901, "", "a"), (902, "secret=token: abcdefgh", "a"), (903, "x" * 100_000, "a"), (903, "deadbeef" * 5000, "a")]
    got = secrets.report(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, base string"))).collect()
    assert len(got) == len(rows)
    want = sorted((i, *[sum(s[3] == k for s in brute(t)) for k in ("assign", "access", "hex")], hashlib.sha256(listed(brute(t)).encode()).hexdigest()) for i, t, _ in rows)
    assert sorted((x.doc_id, x.n_assign, x.n_access, x.n_hex, x.base_sha256) for x in got) == want
    by_id = {x.doc_id: x.spans for x in got}
    for i, t, _ in rows[:-2]:
        assert set(filter(None, listed(brute(t)).split(","))) <= set(by_id[i].split(","))


def test_battery_adds_random_tokens_and_not_words(spark):
    r = random.Random(1)
    key = "".join(r.choice(string.ascii_letters + string.digits) for _ in range(40))
    word = "internationalisation2024andmore"
    text = f"plain {word} text {key} end"
    got = secrets.report(secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert got.spans == f"random:{text.index(key)}:{text.index(key) + 40}"


WORDS = "account archive backup balance branch build cache client cluster config content control counter customer data default device document download element engine error event export field filter folder format gateway handler header image import index input invoice item job kernel language layout library limit list local manager market member message model module monitor network node number object option order output package page parser payment platform policy process product profile project query queue record region release report request resource response result review schema section server service session setting source stage status storage stream style summary support system table target template test thread title transfer update upload user value version video window worker".split()


def ordinary(r):
    """A name of 20 characters or more as people make them, with digits."""
    while True:
        words = [r.choice(WORDS) for _ in range(r.randint(2, 6))]
        style = r.randrange(5)
        if style == 0:
            t = words[0] + "".join(w.title() for w in words[1:])
        else:
            t = ("", "_", "-", "/", "_")[style].join(words)
        t = t.upper() if r.random() < 0.1 else t
        number = r.choice([str(r.randint(0, 99)), f"20{r.randint(10, 29)}", f"20{r.randint(10, 29)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"v{r.randint(1, 9)}"])
        t = t + r.choice(["", "_", "-"]) + number if r.random() < 0.8 else number + "_" + t
        if len(t) >= 20:
            return t


def key(r):
    letters = r.choice([string.ascii_letters + string.digits] * 2 + [string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_"])
    while True:
        t = "".join(r.choice(letters) for _ in range(r.choice([24, 32, 40, 48, 64])))
        if any(c.isdigit() for c in t) and any(c.isalpha() for c in t):
            return t


def test_share_of_false_discoveries_and_recall(spark):
    r = random.Random(17)
    tokens = [(ordinary(r), False) for _ in range(5000)] + [(key(r), True) for _ in range(500)]
    r.shuffle(tokens)
    rows = [(i, f"see {t} there") for i, (t, _) in enumerate(tokens)]
    got = {x.doc_id for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect() if any(s.kind == "random" for s in x.spans)}
    true = {i for i, (_, secret) in enumerate(tokens) if secret}
    assert len(got - true) <= 0.01 * len(got), [tokens[i][0] for i in got - true]
    assert len(got & true) >= 0.9 * len(true), sorted(len(tokens[i][0]) for i in true - got)
    for n in (32, 40, 48, 64):
        own = {i for i in true if len(tokens[i][0]) == n}
        assert len(got & own) >= 0.9 * len(own)


def test_sequences_are_not_random(spark):
    texts = ["abcdefghijklmnopqrstuvwxyz0123456789", "a1b2c3d4e5f6g7h8i9j0k1l2m3n4o5p6", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]
    r = random.Random(2)
    rows = list(enumerate([*texts, *(key(r) for _ in range(20))]))
    got = {x.doc_id for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect() if any(s.kind == "random" for s in x.spans)}
    assert not got & set(range(4)) and len(got) >= 18


def test_many_hits_in_one_text(spark):
    text = " ".join(["0123456789abcdef01234567 token=abcdef"] * 700)
    x = secrets.report(secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (x.n_hex, x.n_assign) == (700, 700) and x.base_sha256 == hashlib.sha256(listed(brute(text)).encode()).hexdigest()


def test_redact_replaces_spans_only(spark):
    docs = spark.createDataFrame([(1, "é password=hunter22 x", "en", 1), (2, "clean", None, 2), (3, None, "de", 3)], "doc_id long, text string, base string, row int")
    got = secrets.redact(docs)
    assert got.columns == docs.columns
    assert [tuple(x) for x in got.orderBy("doc_id").collect()] == [(1, "é [secret] x", "en", 1), (2, "clean", None, 2), (3, None, "de", 3)]


def test_empty_table_and_no_python(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.report(secrets.scan(none)).count() == 0
    assert secrets.redact(none).count() == 0
    plan = secrets.redact(none)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
