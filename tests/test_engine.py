"""The triage engine: kernels, validators, selection, folder runs, export, streaming, queries."""

import base64
import json
import math
import os
import random

import pytest

from conftest import DATA
from triagelake.functions import kernel, patterns, validation
from triagelake.operators import indicators, journal, scan, selection
from triagelake.plans import catalogue, folder, reports
from triagelake.sources import files
from triagelake.streaming import live

RULES = patterns.load()


def only(name):
    return [r for r in RULES if r.name == name]


def hits(name, text):
    return [(d["text"], d["validation"]["status"]) for d in kernel.find_matches(text, 0, "UTF-8", only(name))["match_details"]]


@pytest.mark.parametrize(
    ("name", "text", "want"),
    [
        ("credit_card", "card=4111 1111 1111 1111", [("4111 1111 1111 1111", "validated")]),
        ("credit_card", "card=4111111111111112", [("4111111111111112", "invalid")]),
        ("credit_card", "card=0000000000000000", [("0000000000000000", "invalid")]),
        ("credit_card", "card=411111111111", []),
        ("ip_address", "server=192.168.1.1:8080", [("192.168.1.1", "validated")]),
        ("ip_address", "1.192.168.1.1", []),
        ("ip_address", "abc192.168.1.1", []),
        ("ip_address", "192.168.1.1.example", []),
        ("ip_address", "host=999.999.999.999", []),
        ("mac", "00:1A:2B:3C:4D:5E", [("00:1A:2B:3C:4D:5E", "validated")]),
        ("mac", "00:1A-2B:3C:4D:5E", [("00:1A-2B:3C:4D:5E", "invalid")]),
        ("api_key", "id=0123456789abcdef0123456789abcdef", []),
        ("api_key", "api_key=0123456789abcdef0123456789abcdef", [("0123456789abcdef0123456789abcdef", "candidate")]),
        ("api_key", "monkey=0123456789abcdef0123456789abcdef", []),
        ("URL", "(https://example.com/path).", [("https://example.com/path", "validated")]),
        ("URL", "https://example.com/a_(b)", [("https://example.com/a_(b)", "validated")]),
        ("URL", "http://example.com:99999/a", [("http://example.com:99999/a", "invalid")]),
        ("URL", "https://example.com/%ZZ", [("https://example.com/%ZZ", "invalid")]),
        ("URL", "http://[2001:db8::1]:8080/a", [("http://[2001:db8::1]:8080/a", "validated")]),
        ("URL", "http://ocsp.example.com0A", [("http://ocsp.example.com0A", "candidate")]),
        ("URL", "http://ca.example.com/x.crt0E", [("http://ca.example.com/x.crt0E", "candidate")]),
        ("URL", "http://1_0.0.0.1/a", [("http://1_0.0.0.1/a", "invalid")]),
        ("URL", "http://0x7f.1/a", [("http://0x7f.1/a", "validated")]),
        ("URL", "http://08.0.0.1/a", [("http://08.0.0.1/a", "invalid")]),
        ("URL", "http://.css", [("http://.css", "candidate")]),
        ("URL", "http://localhost/x", [("http://localhost/x", "candidate")]),
        ("litecoin", "LKDxGDJq5fF4FohAB8zJH24mDDNHDNtqsE", [("LKDxGDJq5fF4FohAB8zJH24mDDNHDNtqsE", "validated")]),
        ("zcash", "t1Hsc1LR8yKnbbe3twRp88p6vFfC5t7DLbs", [("t1Hsc1LR8yKnbbe3twRp88p6vFfC5t7DLbs", "validated")]),
        ("file_path", "https://example.org/a/b.txt", [("/example.org/a/b.txt", "invalid")]),
        ("file_path", "　/etc/app.conf", [("/etc/app.conf", "candidate")]),
        ("bitcoin", "x 1BoatSLRHtKNngkdXEeobR76b53LETtpyT", []),
        ("ethereum", "0x" + "ab" * 20 + "\n", []),
    ],
)
def test_matches(name, text, want):
    assert hits(name, text) == want


def test_rules_are_ordered_and_custom_rules_stay_candidates():
    names = [r.name for r in RULES]
    assert len(names) == 30 and names == sorted(names, key=str.encode) and names[:3] == ["Email", "URL", "aeon"]
    custom = patterns.load('URL = "https?://[a-z.]+"\nip_address = "[0-9.]+"')
    assert [d["validation"]["reason"] for d in kernel.find_matches("https://a.b.", 0, "UTF-8", custom)["match_details"]] == [validation.REASONS["custom"]] * 3
    for bad in ('x = "("', "x = 1"):
        with pytest.raises(ValueError):
            patterns.load(bad)
    with pytest.raises(ValueError):
        patterns.load(categories=["url"])


@pytest.mark.parametrize(("name", "yes", "no"), [(n, *pair) for n, pair in catalogue._SHAPES.items()])
def test_shapes_of_rules(name, yes, no):
    assert [t for t, _ in hits(name, yes)] == [yes] and hits(name, no) == []


def test_prefilter_never_loses_a_match():
    rnd = random.Random(8)
    texts = [x for pair in catalogue._SHAPES.values() for x in pair] + [v for _, v, _ in catalogue._SAMPLES] + ["card 4111 1111 1111 1111", "https://a.bc/d", "10.0.0.1", "api_key=" + "a1" * 16, "/etc/app.conf"]
    for _ in range(400):
        text = rnd.choice(["", "x ", "="]) + rnd.choice(texts)[rnd.randrange(3) :] + rnd.choice(["", " ", " y"])
        for rule in RULES:
            assert rule.possible(text) or rule.regex.search(text) is None


def test_one_scan_in_a_plan(spark):
    df = spark.createDataFrame([(1, bytearray(b"https://example.com/a"))], "input_id long, content binary")
    plan = scan.observations(scan.findings(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_entropy_of_windows(spark):
    rnd = random.Random(4)
    data = [rnd.randbytes(n) for n in (0, 1, 4096, 4097, 10000)]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(data)], "input_id long, content binary")
    got = {(r["input_id"], r["offset"]): (r["length"], r["entropy"], r["high"]) for r in scan.entropy_regions(df, base=7).collect()}
    for i, x in enumerate(data):
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            want = -sum(part.count(b) / len(part) * math.log2(part.count(b) / len(part)) for b in set(part))
            n, e, high = got.pop((i, at + 7))
            assert n == len(part) and e == pytest.approx(want, abs=1e-9) and high == (e >= 7)
    assert not got


def test_text_runs():
    data = b"\xffabc\xc3\xa9\x00def\xe2\x82ghij\x00\xe2"
    got = [(r.offset, r.value, r.encoding) for r in kernel.text_runs(data, "utf8", 99)]
    assert got == [(1, "abcé", "UTF-8"), (7, "def", "ASCII"), (12, "ghij", "ASCII")]
    for enc, bom in (("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff")):
        body = bom + "abc😀def\x00tail".encode(enc) + b"x"
        assert [(r.offset, r.length, r.value) for r in kernel.text_runs(body, "auto", 99)] == [(2, 7, "abc😀def"), (20, 4, "tail")]
    with pytest.raises(ValueError):
        list(kernel.text_runs(b"\xff\xfea\0", "utf16be", 9))
    cut = next(kernel.text_runs("ééé".encode(), "utf8", 5))
    assert (cut.value, cut.length, cut.truncated) == ("éé", 3, True)


def test_embedded_runs_and_spans():
    url = "http://example.com/a"
    for pad in (1, 2, 655):
        data = b"\xff" * pad + url.encode("utf-16-le") + b"\0\0\xff"
        found = [f for f in kernel.findings(data, RULES, kernel.Config(encoding="utf8", scan_utf16=True)) if f["encoding"] == "UTF-16LE"]
        d = found[0]["match_details"]
        assert (d[0]["offset"], d[0]["end_offset"], d[0]["text"]) == (pad, pad + 40, url)


def test_fair_retention():
    rules = patterns.load('a = "a"\nip_address = "[0-9.]{7,}"')
    out = kernel.find_matches("a" * 2000 + " 10.0.0.1", 0, "UTF-8", rules)
    assert len(out["match_details"]) == 1000 and out["match_details"][-1]["text"] == "10.0.0.1"
    assert out["match_details_omitted"] == {"a": 1001} and out["match_details_truncated"]
    small = kernel.find_matches("aaaa bbbbbbbb c", 0, "UTF-8", patterns.load('a = "[a-z]+"'), max_bytes=6)
    assert [d["text"] for d in small["match_details"]] == ["aaaa", "c"]


def test_base64_layers():
    cfg = kernel.Config(decode_depth=2)
    url = "https://example.org/decoded"
    once = base64.b64encode(url.encode())
    twice = base64.b64encode(once)
    f = list(kernel.findings(b"skip" + twice, RULES, kernel.Config(decode_depth=2, offset=4)))[0]
    assert [(x["depth"], x["source_offset"], x["next_decode"]) for x in f["decoded_layers"]] == [(1, 4, "decoded"), (2, 4, "not_utf8_base64")]
    assert f["decoded_layers"][1]["match_details"][0]["end_offset"] == len(url)
    f = list(kernel.findings(twice, RULES, kernel.Config(decode_depth=2, max_decode_bytes=len(once))))[0]
    assert [x["next_decode"] for x in f["decoded_layers"]] == ["byte_limit"]
    for budget, status in ((4, "limit"), (5, "decoded")):
        assert next(kernel.findings(b"aGVsbG8=", [], kernel.Config(max_decode_bytes=budget)))["decode_status"] == status
    many = next(kernel.findings(b";".join([b"aGVsbG8="] * 130), [], cfg))
    assert many["decode_status"] == "limit" and len(many["decoded_layers"]) == 128
    for bad in ("aGVsbG8", "aGVsbG9=", "====", "a b="):
        assert kernel.decode_text(bad) is None
    assert next(kernel.findings(b"dGVzdA==", [], kernel.Config()))["decoded_layers"][0]["next_decode"] == "depth_limit"


def test_invariants_on_mutated_bytes():
    rnd = random.Random(9)
    seeds = [b"https://example.com/a b", b"10.0.0.1 a@b.co " * 9, base64.b64encode(b"hello https://a.bc"), "é😀".encode() * 20, "wide".encode("utf-16-le") * 5]
    for _ in range(200):
        data = bytearray(rnd.choice(seeds) + rnd.randbytes(20) + rnd.choice(seeds))
        for _ in range(rnd.randrange(6)):
            data[rnd.randrange(len(data))] = rnd.randrange(256)
        for f in kernel.findings(bytes(data), RULES, kernel.Config(encoding="utf8", scan_utf16=True, max_string_bytes=64, decode_depth=3)):
            assert len(f["value"].encode()) <= 64 and (not f["truncated"] or not f["match_details"] and not f["decoded_layers"])
            codec = "utf-16-le" if f["encoding"] == "UTF-16LE" else "utf-16-be" if f["encoding"] == "UTF-16BE" else "utf-8"
            for d in f["match_details"]:
                assert bytes(data[d["offset"] : d["end_offset"]]) == d["text"].encode(codec)
            for x in f["decoded_layers"]:
                for d in x["match_details"]:
                    assert x["text"].encode()[d["offset"] : d["end_offset"]].decode() == d["text"]


@pytest.mark.parametrize(("rule", "path", "ok"), [("*.bin", "a.bin", 1), ("*.bin", "x/a.bin", 0), ("**/*.bin", "x/y/a.bin", 1), ("**/*.bin", "a.bin", 1), ("a/**", "a", 1), ("a/**/b", "a/b", 1), ("a/**/b", "a/x/y/b", 1), ("a?c", "abc", 1), ("a?c", "a/c", 0), (r"\*", "*", 1), (r"\*", "a", 0), (r"\x61b", "ab", 1), ("A", "a", 0)])
def test_globs(spark, rule, path, ok):
    policy = selection.Policy(includes=(rule,))
    assert policy.matches(path) == bool(ok)
    df = spark.createDataFrame([(path,)], "p string")
    assert (df.select(selection.decision(policy, df.p, df.p.isNull().cast("int")).alias("r")).first()["r"] is None) == bool(ok)


@pytest.mark.parametrize("rule", ["", "a//b", "/a", "a**", "[a]", "a/", "c:x", "a\\q", "."])
def test_bad_globs(rule):
    with pytest.raises(ValueError):
        selection.compile_rule(rule)


def test_strict_json(tmp_path):
    assert files.strict_json('{"a": [1, {"b": null}]}') == {"a": [1, {"b": None}]}
    for bad in ('{"a": 1, "a": 2}', "[" * 70 + "]" * 70, "NaN", '{"a": 1} x', json.dumps({str(i): i for i in range(300)})):
        with pytest.raises(ValueError):
            files.strict_json(bad)
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n{"a"')
    with pytest.raises(ValueError):
        files.json_lines(str(p))


def test_ranges_and_entropy(spark):
    one = files.bytes_input(spark, "x", bytes([0, 1, 0, 1, 2]))
    got = [tuple(r)[1:] for r in scan.entropy_regions(one, 4, 0.5, 10).orderBy("offset").collect()]
    assert got == [(10, 4, 1.0, True), (14, 1, 0.0, False)]
    assert scan.select_range(one, 1, 2).first()["content"] == b"\1\0" and scan.select_range(one, 5).first()["content"] == b""
    with pytest.raises(Exception):
        scan.select_range(one, 6).collect()
    assert scan.hex_dump(files.bytes_input(spark, "x", b"A\0" * 9), 16).orderBy("offset").collect()[1]["line"].startswith("00000020: 41 00 ")
    assert files.number("0x10") == 16


def test_batch_index_budgets_freeze(spark):
    found = [{"input_id": i, "text": f"http://h{j}.example.com/x http://h{j}.example.com/x"} for i in range(6) for j in range(4)]
    df = spark.createDataFrame([(f["input_id"], bytearray(f["text"].encode())) for f in found], "input_id long, content binary").dropDuplicates()
    obs = scan.observations(scan.findings(df, None, only("URL")))
    index = indicators.batch_index(obs, indicators.Limits(keys=3, locations_per_key=2)).collect()
    assert len(index) == 3
    for r in index:
        assert r["distinct_file_entries"] == 6 and r["observed_occurrences"] == 12 and len(r["locations"]) == 2 and r["location_observations_omitted"] == 10
        assert sum(r["validation_reasons"].values()) == 12


def test_single_index_removes_identical_places(spark):
    text = b"https://a.example.com/x https://a.example.com/x config=" + base64.b64encode(b"https://a.example.com/x")
    obs = scan.observations(scan.findings(files.bytes_input(spark, "f", text), None, only("URL")))
    r = indicators.single_index(obs).collect()
    assert [(x["value"], x["observed_occurrences"], x["locations"]) for x in r] == [("https://a.example.com/x", 3, 3)]
    many = b"\0".join([b"https://a.example.com/x"] * 65)
    r = indicators.single_index(scan.observations(scan.findings(files.bytes_input(spark, "f", many), None, only("URL")))).first()
    assert (r["observed_occurrences"], r["locations"], r["locations_omitted"]) == (65, 64, 1)
    lines = reports.index_csv(indicators.single_index(obs), {"a": 1})
    assert len(lines) == 3 and all(x.endswith("\r\n") for x in lines) and lines[2].startswith('"context"')


def test_comparison(spark):
    f = lambda t: indicators.bounded(indicators.comparison_index(indicators.comparison_entries(scan.findings(files.bytes_input(spark, "x", t)))))
    d = indicators.difference(f(b"stable\0gone!\0https://a.bc/d"), f(b"pre\0stable\0https://a.bc/d\0fresh")).collect()
    changes = {(r["change"], (r["before"] or r["after"])["preview"]) for r in d if r["list"] == "string"}
    assert changes == {("removed", "gone!"), ("added", "fresh"), ("changed", "stable"), ("changed", "https://a.bc/d")}
    import hashlib

    key = hashlib.sha256((len("ASCII:text")).to_bytes(8, "little") + b"ASCII:text" + b"fresh").hexdigest()
    assert key in {r["key"] for r in d}


def test_compare_indicators_takes_all_keys(spark, tmp_path):
    n = indicators.MAX_ENTRIES + 50
    mail = lambda i: f"user{i}@host{i}.example.com"
    spark.createDataFrame([(i, mail(i)) for i in range(n)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(n - i, mail(i)) for i in range(1, n + 1)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {(r["change"], r["preview"], r["incomplete_index"]) for r in catalogue.QUERIES["compare_indicators"](spark, str(tmp_path)).collect()}
    assert {g for g in got if g[0] != "changed"} == {("removed", mail(0), False), ("added", mail(n), False)}


def test_comparison_says_when_keys_were_left_out(spark):
    f = lambda t, most: indicators.bounded(indicators.comparison_index(indicators.comparison_entries(scan.findings(files.bytes_input(spark, "x", t)))), most)
    for most, want in ((3, False), (2, True)):
        got = indicators.difference(f(b"first\0second\0third", most), f(b"other", most)).collect()
        assert got and all(r["incomplete_index"] is want for r in got)


def test_evidence_of_every_match(spark, tmp_path):
    import re

    texts = ["a@b.example.com, c@d.example.com; again a@b.example.com", "x" * 60 + " e@f.example.org " + "y" * 60 + " g@h.example.org", "none here", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = [(i, n, m[0], t[: m.start()][-48:], t[m.end() :][:48]) for i, t in enumerate(texts) for n, m in enumerate(re.finditer(patterns.BUNDLED["Email"], t or ""))]
    got = [tuple(r) for r in catalogue.QUERIES["evidence_windows"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(want) == 5


def test_batch_index_of_all_rules(spark, tmp_path):
    from collections import defaultdict

    deep = base64.b64encode(b"see https://deep.example.com/inner for more").decode()
    texts = ["card=4111 1111 1111 1111 to a@b.example.com", "api_key=0123456789abcdef0123456789abcdef", f"again 4111 1111 1111 1111 {deep}"]
    rows = {"documents": ("doc_id long, text string", [(0, texts[0]), (1, None)]), "pages": ("page_id long, html string", [(0, texts[1])]), "conversations": ("conv_id long, turn long, text string", [(0, 1, texts[2])])}
    for name, (shape, data) in rows.items():
        spark.createDataFrame(data, shape).write.parquet(str(tmp_path / f"{name}.parquet"))
    want = defaultdict(list)
    for i, t in enumerate(texts):
        for f in kernel.findings(t.encode(), RULES, kernel.Config().validated()):
            for d in [*f["match_details"], *(d for layer in f["decoded_layers"] for d in layer["match_details"])]:
                want[d["pattern"], d["text"], d["validation"]["status"]].append(i)
    got = {tuple(r[k] for k in indicators.KEY): (r["observed_occurrences"], r["distinct_file_entries"]) for r in catalogue.QUERIES["batch_index_rules"](spark, str(tmp_path)).collect()}
    assert got == {k: (len(v), len(set(v))) for k, v in want.items()}
    assert {"credit_card", "api_key", "Email", "URL"} <= {k[0] for k in got}
    assert catalogue.QUERIES["ranking_rules"](spark, str(tmp_path)).orderBy("rank").first()["value"] == "4111 1111 1111 1111"


def test_reports_and_events(spark):
    one = files.bytes_input(spark, "x", b"https://example.org/fixture\n")
    f = scan.findings(one)
    rep = json.loads(reports.report_json(one, f, scan.entropy_regions(one)).first()["report"])
    assert rep["file_summary"]["size_bytes"] == 28 and rep["strings"][0]["match_details"][0]["evidence"]["boundary_warning"] is None and rep["entropy_regions"][0]["length"] == 28
    assert json.loads(reports.report_json(one, None).first()["report"])["strings"] is None
    kinds = [json.loads(r["line"])["event"] for r in reports.events(one, f, live=True).orderBy("phase", "seq").collect()]
    assert kinds == ["start", "string", "summary", "complete"]
    assert reports.text_lines(f).first()["line"].startswith("0x00000000\tASCII\t27\tURL,file_path\t")


def test_folder_run_and_export(spark, tmp_path):
    root, out = tmp_path / "in", tmp_path / "out"
    (root / "sub").mkdir(parents=True)
    text = b"https://example.org/fixture\n" + base64.b64encode(b"https://example.org/decoded") + b"\n"
    (root / "sample.txt").write_bytes(text)
    (root / "sub/.hidden").write_bytes(b"mail a@example.com")
    (root / "skip.bin").write_bytes(b"x")
    os.symlink("sample.txt", root / "link")
    m = folder.run(spark, str(root), str(out), policy=selection.Policy(excludes=("*.bin",)))
    c = m["counters"]
    assert (c["eligible"], c["complete"], c["policy_skipped"], c["files_with_indicators"]) == (2, 2, 2, 2)
    book = files.journal(spark, str(out / "files.jsonl"))
    assert {r["reason"] for r in book.where("status = 'skipped'").collect()} == {"link", "selection_excluded"} and journal.pair_faults(book).count() == 0
    assert folder.export(spark, str(out), str(tmp_path / "bundle")) == 0
    got = json.loads((tmp_path / "bundle/indicators.json").read_text())
    assert [(r["category"], r["value"], r["validation_status"], r["observed_occurrences"]) for r in got["indicators"]] == [("Email", "a@example.com", "candidate", 1), ("URL", "https://example.org/decoded", "validated", 1), ("URL", "https://example.org/fixture", "validated", 1), ("file_path", "/example.org", "invalid", 2)]
    place = got["indicators"][1]["locations"][0]
    assert (place["source_offset"], place["source_end_offset"], place["decode_depth"], place["decoded_end_offset"]) == (28, 64, 1, 27)
    manifest = json.loads((tmp_path / "bundle/manifest.json").read_text())
    assert manifest["artifacts"]["summary.json"]["bytes"] == (tmp_path / "bundle/summary.json").stat().st_size
    assert (tmp_path / "bundle/indicators.csv").read_bytes().count(b"\r\n") == 5
    lines = (out / "files.jsonl").read_text().splitlines()
    (out / "files.jsonl").write_text("\n".join(lines[1:]) + "\n")
    with pytest.raises(folder.BatchError):
        folder.read_batch(spark, str(out))


def test_folder_reports_are_complete_and_failures_stay_single(spark, tmp_path, monkeypatch):
    root = tmp_path / "in"
    (root / "deep/deeper").mkdir(parents=True)
    (root / "closed").mkdir()
    (root / "a.txt").write_bytes(b"mail a@example.com " * 300)
    (root / "wide").write_bytes("text".encode("utf-16"))
    (root / "deep/deeper/x").write_bytes(b"x")
    real = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: (_ for _ in ()).throw(PermissionError(p)) if str(p).endswith("closed") else real(p))
    m = folder.run(spark, str(root), str(tmp_path / "out"), kernel.Config(encoding="utf16be", entropy=True), selection.Policy(max_depth=1))
    c = m["counters"]
    assert (c["complete"], c["failed"], c["discovery_errors"], c["policy_skipped"]) == (1, 1, 1, 1)
    lines = [json.loads(x) for x in (tmp_path / "out/files.jsonl").read_text().splitlines()]
    assert {x["outcome"]["reason"] for x in lines if "reason" in x.get("outcome", {})} == {"string_analysis", "selection_depth"}
    done = next(x for x in lines if x.get("outcome", {}).get("status") == "complete")
    report = json.loads((tmp_path / "out" / done["outcome"]["report"]["location"]).read_text())
    assert [r["length"] for r in report["entropy_regions"]] == [4096, 1604] and report["analysis_coverage"]["limited"] is False
    assert report["file_summary"]["mime_type"] == "Unknown" and 0 < report["file_summary"]["entropy"] < 8 and report["metadata"]["configuration"]["entropy"]
    codes = {(e["scope"], e["code"]) for e in map(json.loads, (tmp_path / "out/errors.jsonl").read_text().splitlines())}
    assert codes == {("file", "string_analysis"), ("discovery", "directory_read")}
    assert folder.export(spark, str(tmp_path / "out"), str(tmp_path / "b")) == 1


def test_full_scan_by_brute_force(spark):
    docs = spark.read.parquet(str(DATA / "sf0.001/documents.parquet")).select("doc_id", "text").collect()
    want = []
    for i, t in docs:
        for f in kernel.findings((t or "").encode(), RULES, kernel.Config().validated()):
            want += [(i, d["pattern"], d["text"], d["validation"]["status"], d["offset"], d["end_offset"], 0) for d in f["match_details"]]
            want += [(i, d["pattern"], d["text"], d["validation"]["status"], x["source_offset"], x["source_end_offset"], x["depth"]) for x in f["decoded_layers"] for d in x["match_details"]]
    got = [tuple(r) for r in catalogue.QUERIES["full_scan_observations"](spark, str(DATA / "sf0.001")).collect()]
    assert sorted(got) == sorted(want) and want


def test_fingerprint_is_framed(spark):
    import hashlib
    import struct

    body = b"triagelake:patterns:v1\0" + b"".join(struct.pack("<Q", len(x.encode())) + x.encode() for r in RULES for x in (r.name, r.expression))
    assert catalogue.QUERIES["pattern_fingerprint"](spark, "").first()[0] == hashlib.sha256(body).hexdigest()


def test_folder_range_failure(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/short").write_bytes(b"abc")
    (tmp_path / "in/long").write_bytes(b"x" * 50)
    m = folder.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), kernel.Config(offset=30))
    assert m["counters"]["failed"] == 1 and folder.export(spark, str(tmp_path / "out"), str(tmp_path / "b")) == 1
    assert json.loads((tmp_path / "b/summary.json").read_text())["counts"]["selected_bytes"]["eligible_total"] is None


def test_report_id_domain():
    assert folder.report_id("a") != folder.report_id("a", domain=b"other\0") and len(folder.report_id("", raw=b"\xff")) == 64


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for i in range(3):
        (src / f"f{i}").write_bytes(b"https://example.com/%d\0word word" % i)
    f = live.findings_stream(spark, str(src))
    live.write_events(f, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    got = [json.loads(r[0])["data"]["value"] for r in spark.read.text(str(tmp_path / "o")).collect()]
    assert sorted(got) == sorted(r["value"] for r in scan.findings(files.files(spark, str(src))).collect())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, name):
    import duckdb

    got = catalogue.QUERIES[name](spark, str(DATA / "sf0.001"))
    rows = [tuple(r[c] for c in sorted(got.columns)) for r in got.collect()]
    if name not in catalogue.SQL:
        assert rows
        return
    con = duckdb.connect()
    for p in (DATA / "sf0.001").glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(catalogue.SQL[name])
    order = [want.columns.index(c) for c in sorted(got.columns)]
    key = lambda r: tuple(str(round(x, 8)) if isinstance(x, float) else str(x) for x in r)
    assert sorted(map(key, rows)) == sorted(key(tuple(r[i] for i in order)) for r in want.fetchall())


@pytest.mark.parametrize("name", ["batch_index", "match_ip", "validate_ip_neighbors"])
def test_every_match_of_long_strings(spark, tmp_path, name):
    """Strings with more matches than a report keeps, and of more bytes than it scans, against the SQL."""
    import duckdb

    many = ", ".join(f"10.{i // 250}.{i % 250}.7" for i in range(1500))
    texts = [(1, many), (2, "x" * (1 << 20) + " 10.0.0.9"), (3, "ä 10.0.0.9: ß\n10.0.0.9"), (4, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, many)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(1, 0, "10.0.0.9")], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = catalogue.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(catalogue.SQL[name])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_places_in_strings_with_many_matches():
    text = "é 10.0.0.1 ß 10.0.0.2 10.0.0.3"
    rows = kernel.find_matches(text, 5, "UTF-8", only("ip_address"))["match_details"]
    assert [text.encode()[d["offset"] - 5 : d["end_offset"] - 5].decode() for d in rows] == ["10.0.0.1", "10.0.0.2", "10.0.0.3"]
