import hashlib
import re

from ledgerloom.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))


TRICKY = [
    "secret:token: abcdefgh", "PASSWORD='hunter2hunter2' API_KEY=ab apikey = \"0123456789abcdef0123456789abcdef\"", "😀é token=token=abcdefgh",
    "AKIAAKIA" + "X" * 16 + " AKIASHORT AKIA" + "Z9" * 8, "f" * 23 + " " + "f" * 24 + "g" + "0" * 30, "secret:\nabcdefgh", "tokentoken=abcdef", "", "api__key=abcdefg",
]


def test_against_brute_force(spark, small):
    texts = {r["doc_id"]: r["text"] for r in small("documents").collect()}
    texts |= {10_000 + i: t for i, t in enumerate(TRICKY)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = secrets.secret_report(df).collect()
    assert len(got) == len(texts)
    for r in got:
        expected = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(expected.encode()).hexdigest() and r["spans"] == expected
        assert r["n_assign"] == expected.count("assign:") and r["n_hex"] == expected.count("hex:") and r["n_access"] == expected.count("access:")


def test_key_files_add_spans(spark):
    text = "x\n-----BEGIN RSA PRIVATE KEY-----\n"
    got = secrets.secret_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["spans"] == "pem:2:33" and got["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    schema = "doc_id long, text string"
    old = secrets.versions_of(spark.createDataFrame([(1, "token=abcdefgh"), (2, "plain")], schema))
    rules_1 = {1: secrets.BASE_RULES}
    ledger = secrets.Ledger(spark, f"file://{tmp_path}/ledger")
    ledger.scan(old, rules_1)
    assert ledger.read().count() == 2
    new = old.unionByName(secrets.versions_of(spark.createDataFrame([(3, "token=abcdefgh"), (4, "secret=hunter2hunter2")], schema)))
    todo = secrets.unseen_blobs(new, ledger.read(), [1])
    assert [r["text"] for r in todo.collect()] == ["secret=hunter2hunter2"]
    ledger.scan(new, rules_1)
    assert sorted(r["todo"] for r in secrets.unseen_blobs(new, ledger.read(), [1, 2]).collect()) == [[2]] * 3
    found = {r["path"]: len(r["spans"]) for r in secrets.findings_by_path(new, ledger.read()).collect()}
    assert found == {1: 1, 2: 0, 3: 1, 4: 1}
    again = secrets.Ledger(spark, ledger.path, runs=1)  # a second run that died is repeated
    again.scan(new, rules_1)
    assert sorted(map(tuple, again.read().select("blob", "rule_version").collect())) == sorted(map(tuple, ledger.read().select("blob", "rule_version").collect()))
    ledger.scan(new)
    pairs = [tuple(r) for r in ledger.read().select("blob", "rule_version").collect()]
    assert len(pairs) == len(set(pairs)) == 6 and secrets.unseen_blobs(new, ledger.read(), [1, 2]).isEmpty()


def test_odd_rows(odd_docs, no_docs):
    got = secrets.secret_report(odd_docs).collect()
    assert len(got) == 10 and {r["doc_id"]: r["n_assign"] for r in got}[7] == 1
    assert secrets.secret_report(no_docs).count() == 0
