import hashlib
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quern.llm import queries, secret_scan
from tests.llm.conftest import ROWS

ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def by_hand(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def joined(found):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)


PARTS = ["secret", "Token", "API_KEY", "apikey", "passwd", "password", "=", ":", " ", "  ", "'", '"', "abc", "abcdef", "x.y-z/+", "AKIA", "AKIA" + "Q" * 16, "0" * 23, "a1b2c3d4" * 3, "🙂", "é", "\n", "KEY"]


def test_expression_matches_by_hand(spark):
    import random

    rng = random.Random(2)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(0, 25))) for _ in range(1_500)]
    texts += ["secret=token : abcdefgh", "token=" + "token=abcdef " * 400, ("f" * 24 + " ") * 700]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = rows.select("i", secret_scan.spans(secret_scan.findings(F.col("text"))).alias("s"), secret_scan.redacted(F.col("text"), secret_scan.findings(F.col("text"))).alias("clean")).collect()
    for r in got:
        assert r["s"] == joined(by_hand(texts[r["i"]])), texts[r["i"]]
        if not r["s"]:
            assert r["clean"] == texts[r["i"]]
    assert not [r["clean"] for r in got if re.search("a1b2c3d4" * 3, r["clean"])]


@settings(max_examples=5, deadline=None)
@given(st.integers(1, 400))
def test_running_sums(spark, n):
    got = spark.range(1).select(secret_scan._ends(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x.cast("bigint"))).alias("x")).first()["x"]
    assert got == [i * (i + 1) // 2 for i in range(1, n + 1)]


def test_scans_only_what_the_ledger_lacks(spark, odd, tmp_path, monkeypatch):
    ledger = str(tmp_path / "ledger")
    first = secret_scan.scan(odd, ledger).collect()
    assert sorted((str(r["doc_id"]), secret_scan_spans(r)) for r in first) == sorted((str(i), joined(by_hand(t))) for i, t in ROWS)
    place = f"{ledger}/rules={secret_scan.rules_version(secret_scan.RULES)}"
    entries = spark.read.parquet(place).count()
    assert entries == len({t or "" for _, t in ROWS})
    more = odd.select("doc_id", "text").union(spark.createDataFrame([(99, "passwd: hunter22"), (98, "one two three four")], "doc_id long, text string"))
    again = {r["doc_id"]: secret_scan_spans(r) for r in secret_scan.scan(more, ledger).collect()}
    assert again[99] == "assign:0:16" and again[98] == "" and spark.read.parquet(place).count() == entries + 1
    # other rules are another version: all blobs are unseen
    rules = (secret_scan.Rule("word", "three"),)
    other = {r["doc_id"]: secret_scan_spans(r) for r in secret_scan.scan(more, ledger, rules=rules).collect()}
    assert other[1] == "word:8:13" and spark.read.parquet(place).count() == entries + 1


def secret_scan_spans(r):
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["findings"])


def test_a_scan_reads_findings_from_the_ledger(spark, tmp_path):
    docs = spark.createDataFrame([(1, "nothing here")], "doc_id long, text string")
    ledger = str(tmp_path / "l")
    secret_scan.scan(docs, ledger).collect()
    place = f"{ledger}/rules={secret_scan.rules_version(secret_scan.RULES)}"
    told = spark.read.parquet(place).select("blob", F.array(F.struct(F.lit(3).cast("bigint").alias("start"), F.lit(0).alias("place"), F.lit(5).cast("bigint").alias("end"), F.lit("told").alias("kind"))).alias("findings")).collect()
    spark.createDataFrame(told, spark.read.parquet(place).schema).write.mode("overwrite").parquet(place)
    assert secret_scan_spans(secret_scan.scan(docs, ledger).first()) == "told:3:5"  # not scanned again


def test_redact(odd, none, tmp_path):
    clean = secret_scan.redact(odd, str(tmp_path / "a"))
    assert clean.columns == odd.columns
    rows = clean.select("doc_id", "text", "blob").collect()
    assert sorted(str(r["text"]) for r in rows) == sorted(str(t).replace("secret = abcdef123456", "<assign>") for _, t in ROWS)
    assert {r["blob"] for r in rows} == {"own blob"}
    assert secret_scan.redact(none, str(tmp_path / "b")).count() == 0
    assert secret_scan.scan(none, str(tmp_path / "c")).count() == 0


def test_no_python_on_the_main_path(odd, tmp_path):
    plan = secret_scan.scan(odd.where("doc_id is not null").select("doc_id", "text"), str(tmp_path / "x"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_query(spark, small, duck):
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    got = sorted(tuple(r[n] for n in names) for r in queries.op1_secret_scan(spark, small).collect())
    assert got == sorted(duck.sql(queries.ORACLE_SQL["op1_secret_scan"]).select(*names).fetchall())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in got:
        assert r[5] == joined(by_hand(texts[r[0]])) and r[4] == hashlib.sha256(r[5].encode()).hexdigest()
