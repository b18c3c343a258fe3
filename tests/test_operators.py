"""Scans end to end: goldens, equivalences and limits."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from credscan.functions import blocks, groups
from credscan.functions.literals import needles, stands_alone
from credscan.functions.signals import classify_group
from credscan.operators import evaluate, history, models, risk, scan
from credscan.operators.ancestry import reachable
from credscan.operators.matches import matches
from credscan.plans.corpus import scenarios, sources
from credscan.plans.queries import QUERIES, _judged
from credscan.rules import RULES, rules_from
from credscan.sources.files import read_files, read_listed, write_findings
from credscan.streaming import jobs

H = hashlib.md5(b"7").hexdigest()
SK = "sk" + "_live_"


def docs(spark, *texts, path="src/a.py"):
    rows = [(i, path, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, file_path string, content string")


def found(df, *columns):
    return [tuple(r) for r in df.orderBy("doc_id", "line_no", "rule_ord", "match_ord").select(*columns).collect()]


def test_golden_scores(spark):
    texts = ["AK" + "IA" + H[:16].upper(), SK + H[:24], "-----BEGIN " + "RSA PRIVATE KEY-----"]
    assert [r[0] for r in found(scan.scan(docs(spark, *texts)), "combined_score")] == [0.605, 0.65, 0.65]


def test_overlapping_rules_both_report(spark):
    got = found(scan.scan(docs(spark, f'k = "{SK}{H}"')), "rule_id")
    assert got == [("stripe-secret-key",), ("picatic-api-key",)]


def test_minimum_lengths(spark):
    texts = ["sq" + "0atp-" + "a1" * 5, "sq" + "0atp-" + "a1" * 5 + "b", "ya" + "29.ab", "ya" + "29.abc"]
    assert [r[0] for r in found(scan.scan(docs(spark, *texts)), "doc_id")] == [1, 3]


def test_matching_equals_regex_search_per_line(spark):
    """All rules over random texts made of rule-like pieces."""
    r = random.Random(9)
    parts = [H, H[:24], H[:8], "AK" + "IA", "gh" + "p_", SK, "token = ", "PASSWORD:", '"', "'", "\n", " ", "1" + "/",
             "4" + "/", "key" + "-", "-us1", "9", "-", "SK", "secret", "\xa0=\xa0", "a b", chr(0x212A) + "ey-",
             "ya" + "29.", "AI" + "za", "Bearer ", "access_token", ".", "xo" + "xb-"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(400)]
    want = []
    for i, t in enumerate(texts):
        for n, line in enumerate(t.splitlines(), 1):
            for ordinal, rule in enumerate(RULES):
                ms = [m.group(0) for m in re.finditer("(?i)" + re_pattern(rule.pattern), line)]
                ms = [m for m in ms if len(m) >= rule.min_length]
                want += [(i, n, ordinal, k, m) for k, m in enumerate(ms)]
    got = found(matches(docs(spark, *texts), "content"), "doc_id", "line_no", "rule_ord", "match_ord", "secret")
    assert got == want and len(want) > 100


def re_pattern(pattern):
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m.group(1), 16)), pattern)


def test_report_equals_filtered_scan(spark, sf_dir):
    files = sources(spark, sf_dir)
    full = scan.scan(files).where("combined_score >= 0.3")
    report = scan.report(files)
    assert full.exceptAll(report).count() == 0 and report.exceptAll(full).count() == 0


def test_report_below_the_veto_ceiling_keeps_vetoed(spark):
    d = docs(spark, f'# token = "{H}"')
    assert scan.report(d, 0.05).count() == 1 and scan.report(d).count() == 0


@pytest.mark.parametrize("name, layers", [c for c in risk.CONFIGURATIONS if c[0] in ("L1", "L1+L4", "L1+L2+L4")])
def test_ablation_equals_scan_with_layers_off(spark, sf_dir, name, layers):
    files = sources(spark, sf_dir)
    key = ["doc_id", "line_no", "rule_id", "match_ord"]
    one = scan.scan(files, layers=layers).select(*key, F.col("combined_score").alias("score"))
    many = risk.ablation(files).where(F.col("config") == name).select(*key, "score")
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


def test_risk_keeps_clean_texts_and_agrees_with_scan(spark, sf_dir):
    files = sources(spark, sf_dir)
    per_text = risk.risk(files)
    assert per_text.count() == files.count()
    from_scan = scan.scan(files).groupBy("doc_id").agg(F.max("combined_score").alias("s"), F.count("*").alias("n"))
    both = per_text.join(from_scan, "doc_id")
    assert both.count() == from_scan.count()
    assert both.where((F.col("s") != F.col("max_score")) | (F.col("n") != F.col("n_matches"))).count() == 0


def test_published_confusion_counts(spark, sf_dir):
    """Per set of 75 scenarios: 26/29/4/16 without the suppressor, 26/0/4/45 with it."""
    sets = scenarios(spark, sf_dir).count() // 75
    rows = evaluate.rates(evaluate.confusion(_judged(spark, sf_dir), "config")).collect()
    assert len(rows) == 7
    for r in rows:
        want = (26, 0, 4, 45) if "L4" in r["config"] else (26, 29, 4, 16)
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == tuple(sets * x for x in want)
        rates = (1.0, 0.867, 0.929, 0.0) if "L4" in r["config"] else (0.473, 0.867, 0.612, 0.644)
        assert (r["precision"], r["recall"], r["f1"], r["fpr"]) == rates


def test_one_text_with_very_many_hits(spark):
    """One long line and one long block, all matches kept."""
    line = " ".join(f'token = "{hashlib.md5(str(i).encode()).hexdigest()}"' for i in range(3000))
    many = "def f():\n" + "\n".join(f'pwd = "{hashlib.md5(str(i).encode()).hexdigest()}"' for i in range(2000))
    got = {r["doc_id"]: r["n_matches"] for r in risk.risk(docs(spark, line, many)).collect()}
    assert got == {0: 3000, 1: 2000}


def test_every_line_a_hit_and_no_function_marks(spark):
    """Every hit opens a block to the end of the text; the time must follow the text, not its square."""
    many = "\n".join(f'pwd = "{i:040x}" https://x.org/{i % 50}' for i in range(30_000))
    row = risk.risk(docs(spark, many)).first()
    assert row["n_matches"] == 30_000
    few = "\n".join(many.splitlines()[-40:])
    by_line = {r["line_no"]: r["classifier_score"] for r in scan.scan(docs(spark, few)).collect()}
    assert len(by_line) == 40 and len(set(by_line.values())) == 1


@pytest.mark.parametrize("few", [0, 4])
def test_verdicts_on_many_blocks(spark, monkeypatch, few):
    """Blocks read together beside blocks read one by one, with quotes paired in every way."""
    monkeypatch.setattr(blocks, "FEW", few)
    rng = random.Random(1)
    bits = ['"abc"', "'xyz'", '"', "'", "\\", " ", "private", '"private"', '"key x"', "https://a.b/c", '"aws s3"', "test", '"example', "mock'", '\"""', "api.", "\ufdd0"]
    rows = []
    for i in range(60):
        n = rng.randint(1, 40)
        lines = ["".join(rng.choice(bits[: 16 + (i % 9 == 0)]) for _ in range(rng.randint(0, 5))) for _ in range(n)]
        bounds = [(max(1, k - rng.choice([0, 0, 0, 1, 3])), n if rng.random() < 0.8 else min(n, k + 2)) for k in range(1, n + 1) if rng.random() < 0.7]
        rows.append((lines, bounds))
    df = spark.createDataFrame(rows, "lines array<string>, bounds array<struct<first:int,last:int>>")
    alone = F.transform("bounds", lambda b: classify_group(groups.string_group(groups.block_text(F.col("lines"), b))))
    for r in df.select(blocks.block_verdicts(F.col("lines"), F.col("bounds")).alias("got"), alone.alias("want")).collect():
        assert r["got"] == r["want"]


def test_bounds_of_many_lines(spark):
    rng = random.Random(4)
    kinds = ["def f():", "class A:", "protected x", "", "  ", "x = 1", "y = 2", "public z"]
    rows = [([rng.choice(kinds) for _ in range(rng.randint(1, 30))],) for _ in range(60)]
    df = spark.createDataFrame(rows, "lines array<string>")
    numbers = F.sequence(F.lit(1), F.size("lines"))
    one = F.transform(numbers, lambda n: groups.block_bounds(groups.block_marks(F.col("lines")), n))
    for r in df.select(groups.blocks_around(F.col("lines"), numbers).alias("got"), one.alias("want")).collect():
        assert r["got"] == r["want"]


def test_gate(spark):
    rows = [("a", "x.py", f'token = "{H}"'), ("a", "y.py", "ok"), ("b", "z.py", f'# token = "{H}"'), ("c", "w.py", "")]
    df = spark.createDataFrame(rows, "batch string, file_path string, content string")
    got = {r["batch"]: (r["n_files"], r["n_findings"], r["blocked"]) for r in risk.gate(df).collect()}
    assert got == {"a": (2, 1, True), "b": (1, 0, False), "c": (1, 0, False)}


def added(patch):
    """Line numbers and texts of added lines, by counting."""
    out, at = [], 0
    for raw in patch.splitlines():
        header = re.match(r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", raw)
        if header:
            at = int(header.group(1))
        elif raw.startswith("+") and not raw.startswith("+++"):
            out.append((at, raw[1:]))
            at += 1
        elif not raw.startswith(("-", "\\")):
            at += 1
    return out


def test_added_lines(spark):
    r = random.Random(11)
    kinds = ["+new", "+", "-old", " same", "", "\\ No newline", "+++x", "++y", "@@ -1,2 +{},3 @@ f", "@@ -1 +{} @@",
             "@@ bad +3 @@", "--- a"]
    patches = ["\n".join(r.choice(kinds).format(r.randrange(50)) for _ in range(r.randrange(15))) +
               r.choice(["", "\n", "\r\n"]) for _ in range(200)]
    df = spark.createDataFrame([(str(i), "f", p) for i, p in enumerate(patches)], "sha string, file_path string, patch string")
    rows = history.added_lines(df).collect()
    got = sorted((int(x["sha"]), x["block_pos"], x["new_line_no"], x["line"]) for x in rows)
    want = [(i, k, n, s) for i, p in enumerate(patches) for k, (n, s) in enumerate(added(p), 1)]
    assert got == want


def test_history_keeps_the_oldest_exposure(spark):
    commits = spark.createDataFrame(
        [(f"{i}" * 40, i, f"m{i}\nrest", "n", "e") for i in range(1, 5)],
        "sha string, seq long, message string, author_name string, author_email string",
    ).withColumn("committed_at", F.timestamp_seconds(F.col("seq") * 86400))
    patch = f'@@ -1 +7,2 @@\n+x = 1\n+token = "{H}"\n'
    rows = [(f"{i}" * 40, 1, "a.py", "a.py" if i < 4 else "b.py", patch) for i in (3, 2, 1, 4)]
    rows.append(("1" * 40, 2, "a.py", "a.py", patch))
    patches = spark.createDataFrame(rows, "sha string, parent_no int, a_path string, b_path string, patch string")
    all_found = history.scan_patches(patches, commits)
    assert all_found.count() == 4
    first = {(r["file_path"], r["seq"], r["line_approx"], r["message"]) for r in history.first_exposures(all_found).collect()}
    assert first == {("a.py", 1, 8, "m1"), ("b.py", 4, 8, "m4")}
    assert [r["seq"] for r in history.recent(commits, 2).collect()] == [4, 3]


def test_commit_range_over_merges(spark):
    rng = random.Random(2)
    parents = {0: []}
    for i in range(1, 90):  # merges of two and three, several roots, a parent that isn't in the table
        parents[i] = rng.sample(range(max(0, i - 9), i), min(i, rng.choice([1, 1, 1, 2, 3]))) if i % 40 else []
    parents[50].append(1000)
    log = spark.createDataFrame([(f"c{i}", [f"c{p}" for p in ps]) for i, ps in parents.items()], "sha string, parents array<string>")

    def ancestors(i):
        seen, todo = set(), [i]
        while todo:
            if (x := todo.pop()) not in seen and x in parents:
                seen.add(x)
                todo += parents[x]
        return seen

    tips = (89, 70, 3)
    for tip, found in zip(tips, reachable(log, *[f"c{t}" for t in tips]), strict=True):
        got = [r["sha"] for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == {f"c{i}" for i in ancestors(tip)}
    got = {r["sha"] for r in history.commit_range(log, "c70", "c89").collect()}
    assert got == {f"c{i}" for i in ancestors(89) - ancestors(70)}
    with pytest.raises(ValueError, match="no such commit: c900"):
        history.commit_range(log, "c900", "c3")


def test_recent_commits_scan_only_their_patches(spark, sf_dir):
    plan = QUERIES["recent_commits"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    hits = plan.index("Generate explode")  # of matches; what it reads is further down
    assert "LeftSemi" in plan[hits:] and "LeftSemi" not in plan[:hits]


def test_files_and_findings_sink(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.py").write_bytes(b'\xfftoken = "' + H.encode() + b'"\n')
    (tmp_path / "sub" / "b.PNG").write_text(f'token = "{H}"')
    assert read_files(spark, str(tmp_path)).count() == 2
    files = read_files(spark, str(tmp_path), skip_binary=True)
    report = scan.scan(files, keep=())  # the folder's own name counts as a test path
    assert [r["secret"] for r in report.collect()] == [f'token = "{H}"']
    write_findings(report, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    assert read_files(spark, [str(tmp_path / "a.py")]).count() == 1


@pytest.mark.parametrize("layout", ["file", "folder"])
def test_stream_equals_batch(spark, sf_dir, tmp_path, layout):
    files = sources(spark, sf_dir).where("doc_id % 3 = 0").repartition(3)
    files.write.parquet(str(tmp_path / "in.parquet"))
    path = str(tmp_path / "in.parquet")
    if layout == "file":
        files.coalesce(1).write.parquet(str(tmp_path / "one"))
        path = str(tmp_path / "alone.parquet")
        next((tmp_path / "one").glob("part-*.parquet")).rename(path)
    arriving = jobs.read_stream(spark, path, files.schema, 2)
    columns = ["doc_id", "line_no", "rule_id", "match_ord", "combined_score"]
    got = jobs.drain(scan.scan(arriving).select(*columns), str(tmp_path / "out"))
    want = scan.scan(files).select(*columns)
    assert got.count() > 0 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


YEAR = """
    SELECT timestamp_seconds(h * 3600) AS committed_at, h AS seq, 1 AS line_no, 0 AS rule_ord, 0 AS match_ord,
    concat('f', pmod(h * 7, 5)) AS file_path, concat('s', pmod(h * 13, 101)) AS secret,
    CAST(0.3 + pmod(h, 60) / 100 AS double) AS combined_score, CASE WHEN h % 3 = 0 THEN 'high' ELSE 'medium' END AS severity
    FROM (SELECT pmod(id * 7919, 8760) AS h FROM range(8760))"""


@pytest.mark.parametrize("files_per_batch", [1, 1000])
def test_streams_over_a_year_in_any_order(spark, tmp_path, files_per_batch):
    rows = spark.sql(YEAR)
    rows.repartition(6, "secret").write.parquet(str(tmp_path / "in"))

    def arriving():
        return jobs.read_stream(spark, str(tmp_path / "in"), rows.schema, files_per_batch)

    got = jobs.drain_latest(jobs.first_exposures(arriving()), str(tmp_path / "first"), ("file_path", "secret"))
    want = history.first_exposures(rows).select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    days = jobs.drain_latest(jobs.daily_counts(arriving()), str(tmp_path / "daily"), ("day", "severity")).collect()
    assert sum(r["n_findings"] for r in days) == 8760 and len(days) == 730
    assert {r["severity"]: r["n_findings"] for r in days[:2]} and max(r["n_findings"] for r in days) == 16


def arrivals(spark, folder, batches):
    """One file per batch of (time, severity, score), in order of arrival."""
    for i, batch in enumerate(batches):
        rows = spark.createDataFrame(batch, "committed_at string, severity string, combined_score double")
        rows.withColumn("committed_at", F.to_timestamp("committed_at")).coalesce(1).write.parquet(str(folder / f"w{i}"))
        part = next((folder / f"w{i}").glob("part-*.parquet"))
        target = folder / "in" / f"{i}.parquet"
        target.parent.mkdir(exist_ok=True)
        part.rename(target)
        os.utime(target, (1_000_000 + i, 1_000_000 + i))
    return str(folder / "in")


def test_days_close_and_late_findings_are_kept_apart(spark, tmp_path):
    batches = [
        [("2026-01-01 10:00:00", "high", 0.5), ("2026-01-02 00:00:00", "high", 0.6)],
        [("2026-01-01 23:59:59", "high", 0.9)],  # within the delay
        [("2026-01-20 00:00:00", "low", 0.3)],  # closes both days
        [("2026-01-02 12:00:00", "high", 0.7), ("2026-01-19 00:00:00", "low", 0.4)],  # one late, one on time
        [("2026-01-02 13:00:00", "high", 0.4)],
    ]
    folder = arrivals(spark, tmp_path, batches)
    stream = jobs.read_stream(spark, folder, spark.read.parquet(folder).schema, 1)
    on_time, late = jobs.drain_days(stream, str(tmp_path / "out"), delay_days=3)
    told = {(str(r["day"]), r["severity"]): (r["n_findings"], r["max_score"]) for r in on_time.collect()}
    assert told == {
        ("2026-01-01", "high"): (2, 0.9), ("2026-01-02", "high"): (1, 0.6), ("2026-01-20", "low"): (1, 0.3), ("2026-01-19", "low"): (1, 0.4),
    }
    assert {(str(r["day"]), r["severity"]): (r["n_findings"], r["max_score"]) for r in late.collect()} == {("2026-01-02", "high"): (2, 0.7)}


def test_state_of_open_days_is_bounded(spark, tmp_path):
    """A year day by day: the open days carried on are as many after a year as after a month."""
    batches = [[(f"2026-{1 + i // 28:02d}-{1 + i % 28:02d} 05:00:00", "high", 0.5) for i in range(k, k + 28)] for k in range(0, 336, 28)]
    folder = arrivals(spark, tmp_path, batches)
    stream = jobs.read_stream(spark, folder, spark.read.parquet(folder).schema, 1)
    on_time, late = jobs.drain_days(stream, str(tmp_path / "out"), delay_days=5)
    assert on_time.agg(F.sum("n_findings")).first()[0] == 336 and late.count() == 0
    kept = sorted((tmp_path / "out" / "open").iterdir())
    assert len(kept) <= 2 and all(spark.read.parquet(str(k)).count() <= 7 for k in kept)


def test_changes_are_merged_and_sources_may_be_empty(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "MERGED", 2)
    rows = spark.sql(YEAR).where("seq < 400")
    rows.repartition(5, "secret").write.parquet(str(tmp_path / "in"))
    stream = jobs.first_exposures(jobs.read_stream(spark, str(tmp_path / "in"), rows.schema, 1))
    got = jobs.drain_latest(stream, str(tmp_path / "out"), ("file_path", "secret"))
    want = history.first_exposures(rows).select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    left = {x.name for x in (tmp_path / "out" / "data").iterdir()}
    assert sum(x.startswith("upto=") for x in left) == 1 and sum(x.startswith("changed=") for x in left) <= 1
    (tmp_path / "none").mkdir()
    empty = jobs.read_stream(spark, str(tmp_path / "none"), rows.schema)
    assert jobs.drain(empty.select("seq"), str(tmp_path / "a")).count() == 0
    assert jobs.drain_latest(jobs.daily_counts(empty), str(tmp_path / "b"), ("day", "severity")).count() == 0
    assert [x.count() for x in jobs.drain_days(empty, str(tmp_path / "c"))] == [0, 0]


@pytest.mark.parametrize("files_per_batch", [1, 1000])
def test_stream_gate_equals_gate(spark, sf_dir, tmp_path, files_per_batch):
    files = sources(spark, sf_dir).where("doc_id % 2 = 0").repartition(4)
    files.write.parquet(str(tmp_path / "in"))
    arriving = jobs.read_stream(spark, str(tmp_path / "in"), files.schema, files_per_batch)
    got = jobs.drain_latest(risk.gate(arriving), str(tmp_path / "out"), ("batch",))
    want = risk.gate(files)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert got.where("NOT blocked").count() > 0 and got.where("blocked").count() > 0


def test_a_stream_reads_one_file_and_not_its_siblings(spark, tmp_path):
    for name, n in (("t.parquet", 3), ("t.parquet.old", 5)):
        spark.range(n).coalesce(1).write.parquet(str(tmp_path / f"{name}.d"))
        next((tmp_path / f"{name}.d").glob("part-*.parquet")).rename(tmp_path / name)
    stream = jobs.read_stream(spark, str(tmp_path / "t.parquet"), spark.range(1).schema)
    assert jobs.drain(stream, str(tmp_path / "out")).count() == 3


def test_listed_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.py").write_text(f'token = "{H}"')
    (tmp_path / "sub" / "b.py").write_text("clean")
    listed = spark.createDataFrame(
        [("x", f"{tmp_path}/a.py"), ("x", f"{tmp_path}/gone.py"), ("y", f"{tmp_path}/sub/b.py"), ("y", f"{tmp_path}/a.py")], "batch string, file_path string"
    )
    got = sorted((r["batch"], r["file_path"][len(str(tmp_path)):], r["content"]) for r in read_listed(spark, listed, str(tmp_path)).collect())
    assert got == [("x", "/a.py", f'token = "{H}"'), ("y", "/a.py", f'token = "{H}"'), ("y", "/sub/b.py", "clean")]
    assert read_listed(spark, listed.where("file_path LIKE '%gone.py'"), str(tmp_path)).count() == 0


def test_needles_and_rules_from_a_table(spark):
    assert needles(r"tok_[a-z]{5}-(live|prod)") == (("tok_",), ("live", "prod"), ("-",))
    assert needles(r"(?:abc)+x?y") == (("abc",), ("y",)) and needles(r"[0-9]{9,}") == () and needles(r"\p{L}+abc") == ()
    assert needles("K\u212a?e") == (("e",), ("k",)) and needles(r"a|b[0-9]") == (("a", "b"),) and needles(r"a|[0-9]") == ()
    assert stands_alone(r"ab+[0-9]") and not any(map(stands_alone, [r"^ab", r"ab\b", r"(?<=x)ab", r"(a)\1", r"a++b", r"(x|^y)"]))
    table = spark.createDataFrame(
        [("mine", r"^tok-[0-9]{4,}$", None, 6), ("free", r"\S{3}!!", 2, 5), ("aws-access-key", "AKIA[0-9A-Z]{16}", None, None)],
        "rule_id string, regex string, tier int, min_length int",
    )
    rules = rules_from(table)
    assert [(r.rule_id, r.tier, r.min_length, r.custom) for r in rules] == [("aws-access-key", 1, 8, False), ("free", 2, 5, True), ("mine", 3, 6, True)]
    layers = scan.Layers(rules=rules)
    texts = docs(spark, "x\ntok-12345\ny", "tok-12345 x", "a Abc!! b", "nothing", f'token = "{H}"')
    got = {(r["doc_id"], r["rule_id"], r["secret"], r["regex_score"]) for r in scan.scan(texts, layers=layers).collect()}
    assert got == {(0, "mine", "tok-12345", 0.4), (2, "free", "Abc!!", 0.7)}
    assert {r["doc_id"]: r["n_matches"] for r in risk.risk(texts, layers=layers).collect()} == {0: 1, 1: 0, 2: 1, 3: 0, 4: 0}
    with pytest.raises(Exception, match="Unclosed"):
        rules_from(spark.createDataFrame([("bad", "(x")], "rule_id string, regex string"))


def test_classifier_falls_back_and_scores_groups_once(spark):
    seen = []

    def add(groups):
        seen.append(groups.count())
        return groups.withColumn("probability", F.when(~F.col("group_text").contains("odd"), 0.9))

    texts = docs(spark, f'x = "odd"\ntoken = "{H}"\n', *[f'token = "{H}"'] * 4, f"token = {H}")
    found = scan.scan(texts, layers=scan.Layers(classifier=scan.Classifier("mine", add)))
    plain = {r["doc_id"]: r["classifier_score"] for r in scan.scan(texts).collect()}
    got = {r["doc_id"]: (r["model_used"], r["classifier_score"]) for r in found.collect()}
    assert got == {0: ("mine", 0.9) if 0 not in plain else got[0], **{i: ("mine", 0.9) for i in range(1, 5)}, 5: ("none", 0.0)}
    odd = docs(spark, f'def f():\n  x = "odd one"\n  token = "{H}"\n')
    fallen = scan.scan(odd, layers=scan.Layers(classifier=scan.Classifier("mine", add))).first()
    assert (fallen["model_used"], fallen["classifier_score"]) == ("heuristic_fallback", scan.scan(odd).first()["classifier_score"])
    assert seen == [1, 1]


def test_training_on_groups_finds_the_minimum(spark, tmp_path):
    """Weights of the fitted model beside Newton's method on the same features and objective."""
    texts = [f'def f():\n  a = "{w} https"\n  token = "{H}"\n' for w in ("live charge", "live payment", "mock test", "test fixture", "mock live", "sample")]
    rows = docs(spark, *texts).withColumn("label", F.col("doc_id").isin(0, 1, 4).cast("int"))
    examples = models.labelled_groups(rows, F.col("label"))
    assert examples.count() == 6 and {r["group_size"] for r in examples.collect()} == {2}
    fitted = models.saved(models.train(examples, "group_text"), str(tmp_path / "model"))
    weighted, n = models.balanced(examples)
    plain = fitted.transform(weighted).select("features", "label", "weight", "probability").collect()
    x = np.array([[*r["features"].toArray(), 1.0] for r in plain])
    y, w = (np.array([r[c] for r in plain], float) for c in ("label", "weight"))
    penalty = np.full(x.shape[1], 1 / (2.0 * n))
    penalty[-1] = 0
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        slope = x.T @ (w * (p - y)) / w.sum() + penalty * beta
        curve = (x.T * (w * p * (1 - p))) @ x / w.sum() + np.diag(penalty) + 1e-12 * np.eye(len(beta))
        beta -= np.linalg.solve(curve, slope)
    want = 1 / (1 + np.exp(-x @ beta))
    assert [r["probability"][1] for r in plain] == pytest.approx(want.tolist(), abs=2e-3)
    found = models.probability_of(fitted, least_words=3)(examples).collect()
    assert {(r["probability"] is None) for r in found} == {len(r["group_text"].split()) < 3 for r in found}


def test_texts_are_scanned_once_for_training(spark):
    """Training reads its examples several times; what it reads are the groups, not the texts again."""
    rows = docs(spark, f'def f():\n  a = "live charge"\n  token = "{H}"\n', f'x = "mock test"\ntoken = "{H}"\n').withColumn("label", F.lit(1))
    examples = models.labelled_groups(rows, F.col("label"))
    plan = examples._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "parquet" in plan
    assert examples.columns == ["group_key", "label", "group_text", "group_size"] and examples.count() > 0


def test_nothing_runs_while_a_query_is_built(spark, sf_dir):
    fits = {  # a fit, an iteration, or a sink that is read back
        "train_text_classifier", "model_scores", "cv_metrics", "context_similarity", "findings_report", "range_findings", "custom_rules",
        "similarity_scan", "similarity_gate", "train_group_classifier", "evaluation_report", "scan_files", "gate_file_list",
    }
    tracker, ran = spark.sparkContext.statusTracker(), []
    for name, build in QUERIES.items():
        if name not in fits and not name.startswith("stream_"):
            spark.sparkContext.setJobGroup(f"build {name}", name)
            build(spark, sf_dir)
            stages = [s for j in tracker.getJobIdsForGroup(f"build {name}") for s in tracker.getJobInfo(j).stageIds]
            # reading the schema of a table is a job of the reader
            if any(not tracker.getStageInfo(s).name.startswith("parquet at") for s in stages):
                ran.append(name)
    spark.sparkContext.setJobGroup("tests", "tests")
    assert ran == []


def test_missing_paths_give_no_rows(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1")
    listed = [str(tmp_path / "a.py"), str(tmp_path / "gone.py"), str(tmp_path / "*.none")]
    assert [r["content"] for r in read_files(spark, listed).collect()] == ["x = 1"]
    assert read_files(spark, str(tmp_path / "gone.py")).count() == 0


def test_stratified_folds_deal_every_label_evenly(spark):
    df = spark.range(1003).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))
    sizes = models.stratified_folds(df, "id").groupBy("label", "fold").count().collect()
    for label in (0, 1):
        counts = [r["count"] for r in sizes if r["label"] == label]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_context_similarity(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.0, 2.0],), ([0.0, 0.0],)], "v array<float>")
    got = [r[0] for r in df.select(models.context_similarity(F.col("v"), [[1, 0]], [[1, 1]])).collect()]
    assert got == [0.586, 0.0, 0.0]
