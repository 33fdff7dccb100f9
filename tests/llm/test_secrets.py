import hashlib
import re

from pyspark.sql import functions as F
from quillmill.llm import secrets as S

TEXTS = [
    'API-key="abcdef123" password: short, Secret = "longenough"',
    "AKIA" + "A" * 16 + " AKIAshort",
    "deadbeef" * 4 + "xyz" + "0" * 23,
    "é🙂 token=abc.def/gh",
    "-----BEGIN RSA PRIVATE KEY-----\nMIIEpAIBAAKCAQEA\nabcdEFGH\n-----END RSA PRIVATE KEY----- prose goes on",
    "ghp_" + "a1" * 18 + " Bearer " + "t" * 24,
    "clean text of a secretary",
]


def test_base_spans_by_plain_matching(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in S.secret_report(df).collect()}
    patterns = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    for k, t in enumerate(TEXTS):
        found = sorted((m.start(), j, f"{kind}:{m.start()}:{m.end()}") for j, (kind, p, g, n) in enumerate(patterns) for m in p.finditer(t) if len(m[g]) >= n)
        assert rows[k]["base_sha256"] == hashlib.sha256(",".join(x[2] for x in found).encode()).hexdigest()
        assert [rows[k][f"n_{kind}"] for kind, *_ in patterns] == [sum(x[1] == j for x in found) for j in range(3)]


def test_more_kinds(spark):
    rows = {r["doc_id"]: r["spans"] for r in S.secret_report(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()}
    assert rows[4] == "pem:0:87"
    assert rows[5].startswith("forge:0:40,hex:4:40,bearer:41:")
    assert rows[6] == ""


def test_a_private_key_goes_whole(spark):
    body = "MIIEpAIBAAKCAQEA" * 40
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    headed = f"{begin}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n{body[:64]}\n{body[64:100]}\n"
    texts = [f"{begin}{body}{end}", f"{begin}\n{body}\n{end}", f"{begin} {body} {end}", headed + end, f"{begin}\\n{body}\\n{end}", f"{begin}\n> {body[:64]}\n> {end}"]
    open_ended = [f"{begin}\n{body}", headed.rstrip()]
    df = spark.createDataFrame([(k, f"see {t} so") for k, t in enumerate([*texts, *open_ended])], "doc_id long, text string")
    assert {r["text"] for r in S.redact(df, rules=S.WHOLE_RULES).collect()} == {"see [pem] so"}
    assert S.Scanner(S.WHOLE_RULES)(f"{begin}\n{texts[0]} prose {texts[1]}")[0][2] == len(begin)
    many = begin * 20_000
    assert len(S.Scanner(S.WHOLE_RULES)(many)) == 20_000


def test_hints_are_implied_by_their_rules(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    for r in S.RULES:
        hit = {x["text"] for x in df.where(F.col("text").rlike(r.hint)).collect()}
        assert {t for t in TEXTS if re.search(r.pattern, t, r.flags)} <= hit


def test_ledger_scans_only_unseen_pairs(spark):
    old = spark.createDataFrame([(1, TEXTS[0]), (2, "clean")], "doc_id long, text string")
    ledger = S.scan_new(old)
    both = old.unionByName(spark.createDataFrame([(3, TEXTS[1]), (4, TEXTS[0]), (5, TEXTS[1])], "doc_id long, text string"))
    fresh = S.scan_new(both, ledger)
    assert fresh.count() == 1
    report = lambda df, book=None: sorted(map(tuple, S.secret_report(df, book).collect()))
    assert report(both, ledger) == report(both)
    changed = (*S.RULES[:-1], S.Rule("bearer", "Bearer x", "Bearer"))
    assert S.scan_new(both, ledger, changed).count() == 3
    assert S.scan_new(both, S.empty_ledger(spark)).count() == 3


def test_the_report_comes_from_the_stored_ledger(spark):
    """What the ledger says of a blob is what its paths get, and a pair held twice counts once."""
    df = spark.createDataFrame([(k, TEXTS[k % 2]) for k in range(6)], "doc_id long, text string")
    want = sorted(map(tuple, S.secret_report(df).collect()))
    ledger = S.ledger_of(df, batches=3)
    assert ledger.count() == 2
    assert sorted(map(tuple, S.secret_report(df, ledger.unionByName(ledger)).collect())) == want
    forgot = ledger.withColumn("found", F.expr(f"CAST(array() AS {S.FINDINGS})"))
    assert {r["spans"] for r in S.secret_report(df, forgot).collect()} == {""}
    assert S.scan_new(df, ledger).isEmpty()


def test_a_stored_table_is_a_ledger(spark, tmp_path):
    old = spark.createDataFrame([(1, TEXTS[0])], "doc_id long, text string")
    S.scan_new(old).write.parquet(f"{tmp_path}/ledger")
    ledger = spark.read.parquet(f"{tmp_path}/ledger")
    both = old.unionByName(spark.createDataFrame([(2, TEXTS[0]), (3, TEXTS[1])], "doc_id long, text string"))
    assert S.scan_new(both, ledger).count() == 1
    assert sorted(map(tuple, S.secret_report(both, ledger).collect())) == sorted(map(tuple, S.secret_report(both).collect()))


def test_redaction(spark, edge, none):
    df = spark.createDataFrame([(1, "a password=hunter2hunter b", 26), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: tuple(r) for r in S.redact(df).collect()}
    assert got == {1: (1, "a [assign] b", 12), 2: (2, None, None), 3: (3, "clean", 5)}
    assert S.redact(edge).columns == edge.columns
    assert S.redact(edge).count() == edge.count()
    assert S.redact(none).count() == 0


def test_edges(edge, none):
    rows = S.secret_report(edge).collect()
    assert len(rows) == edge.count()
    assert next(r for r in rows if r["doc_id"] == 6)["n_assign"] == 1
    assert next(r for r in rows if r["doc_id"] == 2)["spans"] == ""
    assert S.secret_report(none).count() == 0
