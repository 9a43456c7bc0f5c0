"""Behaviours of runs, selections, folders, answers, sources, streams and the model boundary."""

import base64
import collections
import json
import math
import random
import re
import threading
import time
import uuid
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkwell import catalog, inference
from inkwell.functions import answers, measures, strings
from inkwell.operators import joins, ordered, selection, summary, views
from inkwell.plans.records import merge_parameters
from inkwell.sources import archives, contract, files, rest, runs, sinks, taskfiles
from inkwell.streaming import live

RESULT = "seq long, model string, status string, accuracy double, latency double, tokens_per_second double, output_tokens long, cer double, wer double, table_score double, math_score double, iban_emr double, amount_emr double, device string"


def results(spark, rows):
    return spark.createDataFrame([(i, m, s, a, t, None, None, None, None, None, None, None, None, "cpu") for i, (m, s, a, t) in enumerate(rows)], RESULT)


def test_failures_are_not_scored(spark):
    row = summary.model_summary(results(spark, [("a", "success", 0.5, 1.0), ("a", "failed", None, 9.0)])).first()
    assert (row.documents, row.success_rate, row.quality, row.latency_mean) == (2, 0.5, 0.5, 1.0)
    assert row.output_tokens is None and row.table_score is None
    none = summary.model_summary(results(spark, [("a", "failed", None, 0.0)])).first()
    assert none.quality is None and none.documents_per_second is None


def test_reliable_model_is_recommended_before_a_better_one(spark):
    rows = [("good", "success", 1.0, 1.0)] * 3 + [("good", "failed", None, 1.0)] + [("safe", "success", 0.8, 2.0)] * 4
    found = summary.model_summary(results(spark, rows))
    assert summary.recommended(found).first().model == "safe"
    assert [r.model for r in summary.ranked(found).orderBy("rank").collect()] == ["safe", "good"]


def test_run_stops_after_the_error_that_is_too_many(spark):
    rows = results(spark, [("a", s, None, 1.0) for s in ("success", "failed", "success", "failed", "success", "failed")])
    assert summary.until_errors(rows, ["model"], 2).count() == 4
    assert summary.until_errors(rows, ["model"], 0).count() == 6
    last = summary.progress(rows, ["model"]).orderBy(F.desc("seq")).first()
    assert (last.done, last.left, last.errors) == (6, 0.0, 3)
    assert [r.position for r in summary.live_tail(rows, 2).orderBy("position").collect()] == [5, 6]


def test_samples_are_repeatable_and_bounded(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "id long, category string")
    one, two = (sorted(r.id for r in selection.sample(rows, 5, 42, "id").collect()) for _ in range(2))
    assert one == two and len(set(one)) == 5
    assert selection.sample(rows, 50, 42, "id").count() == 20
    with pytest.raises(ValueError):
        selection.sample(rows, 0, 42, "id")
    quotas = spark.createDataFrame([("a", 1), ("b", 2)], "category string, requested int")
    assert {r.category: r["count"] for r in selection.sample_by(rows, quotas, 1, "id", "category").groupBy("category").count().collect()} == {"a": 1, "b": 2}
    assert [r.id for r in selection.at_mask(rows.withColumnRenamed("id", "position"), spark.createDataFrame([(3, True), (4, False)], "position long, ticked boolean")).select(F.col("position").alias("id")).collect()] == [3]


def test_hosts(spark):
    df = spark.createDataFrame([("https://good.test/x",), ("https://bad.test",), ("ftp://good.test",), (None,)], "u string")
    assert [r[0] for r in df.select(selection.host_allowed(F.col("u"), ["good.test"])).collect()] == [True, False, False, False]
    assert not any(r[0] for r in df.select(selection.host_allowed(F.col("u"), [])).collect())


def test_numbering_has_no_gaps(spark):
    got = views.numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("id")), F.col("id").asc(), "id", 7).orderBy("id").collect()
    assert [(r.id, r.position) for r in got] == [(i, i + 1) for i in range(1000)]


def test_lines_of_boxes(spark):
    boxes = [(1, 0.0, 50.0, 10.0, "b"), (1, 4.0, 0.0, 10.0, "a"), (1, 30.0, 5.0, 10.0, "c"), (1, 38.0, 0.0, 10.0, "d"), (2, 0.0, 0.0, 2.0, "x")]
    df = spark.createDataFrame(boxes, "page int, top double, left double, height double, text string")

    def plain(rows):
        lines = []
        for top, left, height, text in sorted(r[1:] for r in rows):
            middle = top + height / 2
            if lines and abs(middle - sum(m for m, *_ in lines[-1]) / len(lines[-1])) <= 10:
                lines[-1].append((middle, left, text))
            else:
                lines.append([(middle, left, text)])
        return "\n".join(" | ".join(t for _, _, t in sorted(x, key=lambda y: y[1:])) for x in lines)

    got = {r.page: r.text for r in views.lines_of(df, "page").collect()}
    assert got == {p: plain([b for b in boxes if b[0] == p]) for p in (1, 2)}
    assert got[1] == "a | b\nd | c"


def test_sides_and_latest(spark):
    rows = spark.createDataFrame([("c1", "recto", "b"), ("c1", "recto", "a"), ("c1", "verso", "v"), ("c2", "verso", "w")], "client string, side string, path string")
    got = {r.client: r for r in joins.sides(rows, "client", "side").collect()}
    assert got["c1"].recto_source == "a" and got["c1"].issues == ["duplicate_recto"] and got["c1"].status == "ready"
    assert got["c2"].issues == ["missing_recto"] and got["c2"].status == "incomplete"
    events = spark.createDataFrame([(1, 1, "new", "x"), (1, 2, "done", None)], "id int, seq int, state string, note string")
    assert tuple(joins.latest(events, "id", "seq", ["state", "note"]).first()) == (1, "done", "x")
    with pytest.raises(ValueError):
        joins.model_cases(spark.range(joins.MOST_MODELS + 1), rows)


def test_answers(spark):
    replies = ['```json\n{"cin": " A1 ", "nom": {"x": 1}, "prenom": true, "other": 2}\n```', "none", '{"cin": }', None]
    df = spark.createDataFrame([(r,) for r in replies], "r string")
    rows = answers.with_parsed(df, "r", "p").select(F.col("p_error").alias("e"), answers.side(F.col("p"), answers.RECTO).alias("s")).collect()
    assert [r.e for r in rows] == [None, "model_response_not_json", "model_response_invalid_json", "model_response_not_json"]
    assert rows[0].s.cin == "A1" and rows[0].s.nom is None and rows[0].s.prenom == "True" and rows[1].s.cin is None
    pairs = spark.createDataFrame([("A-1", "a1"), ("A1", "B2"), ("A1", None), (None, None)], "a string, b string")
    value, same = answers.merged(F.col("a"), F.col("b"))
    assert [tuple(r) for r in pairs.select(value, same).collect()] == [("A-1", True), (None, False), ("A1", None), (None, None)]
    got = spark.createDataFrame([("É-1", "1"), (None, "x"), ("x", None), ("x", "y")], "a string, b string").select(answers.compared(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == ["correct", "label_missing", "missing_model", "different"]
    merged = spark.range(1).select(merge_parameters(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"), F.lit("a"), F.lit(None).cast("string"))).alias("m")).first().m
    assert merged == {"a": "1", "b": "3"}


def test_case_folding_matches_python(spark):
    letters = [chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0xFB00, 0xFB07)] + ["\u212a", "ẞ"]
    got = spark.createDataFrame([(f"x{c}1",) for c in letters], "a string").select("a", answers.bare(F.col("a")).alias("b")).collect()
    assert {r.a: r.b for r in got} == {f"x{c}1": re.sub("[^a-z0-9]", "", f"x{c}1".casefold()) for c in letters}


def test_labels_of_sides_and_payloads(spark):
    labels = ['{"cin": "1", "recto": {"cin": "2"}}', '{"cin": null, "recto": {"cin": "2"}, "verso": {"cin": "3"}}', '{"recto": {"cin": null}, "verso": {"cin": "3"}}', '{"recto": 5, "verso": {"cin": 3}}', "{}", None, "[1]"]
    df = spark.createDataFrame([(x,) for x in labels], "a string").select(F.try_parse_json("a").alias("v"))
    assert [r[0] for r in df.select(answers.expected(F.col("v"), "cin")).collect()] == ["1", "2", None, "3", None, None, None]
    data = {"cin_id": " A1 ", "birth_date": "05/01/1990", "first_name_confidence": 12.5, "address": "", "validity_date": "2030-02-01 x", "phone": "1"}
    payload = json.dumps({"response": {"body": {"response_data": {"customer": {"id": 7, "customer_data": data}}}}})
    rows = spark.createDataFrame([(payload,), ("{}",)], "a string").select(F.parse_json("a").alias("v"))
    one, none = rows.select(*[c.alias(n) for n, c in answers.customer_label(F.col("v")).items()]).collect()
    assert (one.cin, one.prenom, one.date_naissance, one.date_validite, one.adresse, one.customer_id) == ("A1", None, "1990-01-05", "2030-02-01", None, "7")
    assert one.field_confidence == {"prenom": 12.5} and none.cin is None and none.field_confidence == {} and none.label_source == "customer_data"


def test_field_contract(tmp_path):
    assert contract.fields() == contract.fields(str(tmp_path / "none.json")) == {"recto": answers.RECTO, "verso": answers.VERSO}
    path = tmp_path / "fields.json"
    path.write_text(json.dumps({"recto": [{"key": "a", "type": "text"}], "verso": []}))
    assert contract.fields(str(path)) == {"recto": ("a",), "verso": ()}
    for bad in ("{", "[]", '{"recto": []}', '{"recto": [{"type": "x"}], "verso": []}', '{"recto": [{"key": 1}], "verso": []}'):
        path.write_text(bad)
        with pytest.raises(ValueError):
            contract.fields(str(path))
    with pytest.raises(ValueError):
        answers.prompt("left", contract.fields(), F.lit(None))


def test_plans_parse_and_extract_once(spark):
    def plan(name):
        return catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()

    for name, times in (("n2_parse_side", 1), ("n3_parse_combined", 1), ("n6_global_record", 1), ("n7_field_compare", 2), ("j8_label_vs_extraction", 2)):
        assert len(re.findall("parse_json|parseJson", plan(name), re.IGNORECASE)) <= times, name  # two tables are parsed where labels are
    found = plan("x9_evaluate_bank")
    assert found.count("regexp_extract_all") <= 6 and "Exchange hashpartitioning(o_orderkey" in found


def test_strings_and_dates(spark):
    row = spark.createDataFrame([("31/12/2024 x", "2024-1-5", "soon", "..a b//", "http://u:p@h:1")], "a string, b string, c string, d string, e string")
    got = row.select(*[measures.iso_date(F.col(c)) for c in "abc"], strings.safe_name(F.col("d")), strings.mask_password(F.col("e")), strings.file_side(F.lit("77_RECTO.jpg"), "_recto")).first()
    assert tuple(got) == ("2024-12-31", "2024-01-05", "soon", "a_b", "http://u:***@h:1", "77")
    box = measures.crop(F.lit(1200), F.lit(1600), (F.lit(20), F.lit(20), F.lit(620), F.lit(395)))
    assert spark.range(1).select(box["crop_status"]).first()[0] == "crop_detected"
    states = spark.createDataFrame([("timeout", "failed"), ("failed", "invalid_json"), ("success", "invalid_json"), ("success", "success")], "a string, b string")
    assert [r[0] for r in states.select(measures.reduced_status(F.col("a"), F.col("b"))).collect()] == ["timeout", "failed", "invalid_json", "success"]


def test_catalog_annotations_and_folders(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"image_path": "a\\b.png", "ground_truth": "t", "category": "x"}, {"image_path": "c.png"}]))
    rows = files.catalog(spark, str(tmp_path / "c.json"))
    assert rows.first().image_path == "a/b.png"
    assert files.violations(rows).first().missing == ["ground_truth", "category"]
    (tmp_path / "f").mkdir()
    (tmp_path / "f/one.json").write_text(json.dumps({"form": [{"box": [1, 2, 3, 4], "text": "hi", "label": "q", "words": [], "linking": [[0, 1]], "id": 0}]}))
    assert tuple(files.boxes(files.annotations(spark, str(tmp_path / "f"))).first()) == ("one", 2.0, 1.0, 2.0, "hi")
    for name in ("9/x_recto.pdf", "9/x_verso.png", "8/y_recto.png", "8/note.txt"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text("x")
    got = {r.client: r.status for r in files.folder(spark, str(tmp_path / "in"), {"recto": "_recto", "verso": "_verso"}).collect()}
    assert got == {"9": "ready", "8": "incomplete"}


def test_archives(spark, tmp_path):
    for name, members in (("bad.zip", ["ok.txt", "../outside.txt"]), ("good.zip", ["in/ok.txt"])):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for m in members:
                z.writestr(m, "x")
    with pytest.raises(ValueError):
        files.unzip(str(tmp_path / "bad.zip"), str(tmp_path / "t"))
    assert not (tmp_path / "t").exists()
    assert len(files.unzip(str(tmp_path / "good.zip"), str(tmp_path / "t"))) == 1


def shop(root):
    """A store that is no local folder: addresses shop://x under a root that only the opener knows."""

    def opened(address):
        return fs.SubTreeFileSystem(str(root), fs.LocalFileSystem()), address.removeprefix("shop://")

    return opened


def test_archives_are_split_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "TASK_BYTES", 300)
    (tmp_path / "in").mkdir()
    for name, some in (("good.zip", {f"in/{i}.txt": f"text {i} " * 20 for i in range(12)}), ("bad.zip", {"ok.txt": "x", "../outside.txt": "y"}), ("drive.zip", {"C:x": "z"})):
        with zipfile.ZipFile(tmp_path / "in" / name, "w", zipfile.ZIP_DEFLATED) as z:
            z.mkdir("empty/")
            for m, text in some.items():
                z.writestr(m, text)
    with zipfile.ZipFile(tmp_path / "in" / "torn.zip", "w") as z:
        z.writestr("a.txt", "first" * 50)
        z.writestr("b.txt", "second" * 50)
    torn = (tmp_path / "in" / "torn.zip").read_bytes()
    (tmp_path / "in" / "torn.zip").write_bytes(torn.replace(b"firstfirst", b"firxtfirst", 1))
    (tmp_path / "in" / "none.zip").write_bytes(b"no archive")
    paths = spark.createDataFrame([(f"shop://in/{n}.zip",) for n in ("good", "good", "bad", "drive", "torn", "none", "lost")] + [(None,)], "path string")
    listed = archives.members(paths, opened=shop(tmp_path))
    told = collections.defaultdict(list)
    for r in listed.collect():
        told[r.archive].append((r.member, r.error))
    assert len(told["shop://in/good.zip"]) == 12 and told["shop://in/bad.zip"] == [(None, "unsafe member: ../outside.txt")] and "C:x" in told["shop://in/drive.zip"][0][1]
    assert told["shop://in/none.zip"][0][0] is None and told["shop://in/none.zip"][0][1] and "FileNotFoundError" in told["shop://in/lost.zip"][0][1]
    assert archives.dealt(listed).rdd.getNumPartitions() >= 8
    found = {(r.archive[10:], r.member): (r.content, r.error) for r in archives.contents(listed, opened=shop(tmp_path)).collect()}
    assert {m: bytes(c).decode() for (a, m), (c, _) in found.items() if a == "good.zip"} == {f"in/{i}.txt": f"text {i} " * 20 for i in range(12)}
    assert "CRC" in found["torn.zip", "a.txt"][1] and bytes(found["torn.zip", "b.txt"][0]) == b"second" * 50
    wrote = archives.extract(listed, "shop://out", most=250, opened=shop(tmp_path)).collect()
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file()) == sorted(f"good/in/{i}.txt" for i in range(12))
    assert {r.member for r in wrote if r.error and "too large" in r.error} == {"b.txt"} and sum(r.path is not None for r in wrote) == 12


def test_retention_spares_other_folders(tmp_path):
    for name in ("20240101-000000-0a1b2c3d", "cni-20240101-000000-0a1b2c3d", "keep"):
        (tmp_path / name).mkdir()
    now = 10**10
    assert sinks.purge_runs(str(tmp_path), None, now) == []
    assert len(sinks.purge_runs(str(tmp_path), 30, now)) == 2 and (tmp_path / "keep").exists()
    with pytest.raises(ValueError):
        files.run_results(None, str(tmp_path), "../x", "a int")


def test_catalog_append_refuses(spark, tmp_path):
    rows = spark.createDataFrame([("a.png", " Big Cat ", "t", 5), ("a.exe", "c", "t", 5), ("a.png", "c", " ", 5), ("a.png", "c", "t", 16 << 20)], "image_path string, category string, ground_truth string, bytes long")
    refused = sinks.append_catalog(rows, str(tmp_path / "c"))
    assert sorted(r.error for r in refused.collect()) == ["extension", "label", "size"]
    assert spark.read.json(str(tmp_path / "c")).first().category == "big_cat"


#: Queries and paths of addresses that count them.
asked = []


@pytest.fixture
def server():
    """Answers by path: documents, listings of three pages, client routes, a chat."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, kind, body, status=200):
            self.send_response(status)
            if kind:
                self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(body if isinstance(body, bytes) else json.dumps(body).encode())

        def do_GET(self):
            path, _, query = self.path.partition("?")
            values = dict(x.split("=", 1) for x in query.split("&") if x)
            if "doc" in path:
                self.answer("application/pdf", b"%PDF")
            elif path == "/numbered":
                self.answer("application/json", [int(values["page"])] if int(values["page"]) < 4 else [])
            elif path == "/tokens":
                n = int(values.get("page_token", "0"))
                self.answer("application/json", {"files": [n], "next": str(n + 1) if n < 2 else None})
            elif path == "/long":
                self.answer("application/json", "x" * 250_000)
            elif path == "/same":
                self.answer("application/json", ["same"])
            elif path == "/endless":
                self.answer("application/json", [int(values["page"])])
            elif path == "/stuck":
                asked.append(path)
                self.answer("application/json", {"files": [len(asked)], "next": "1"})
            elif path == "/growing":
                asked.append(query)
                n = int(values.get("page_token", "0"))
                self.answer("application/json", {"files": [n], "next": str(n + 1) if n < 5 else None})
            elif path.startswith("/flaky/"):
                asked.append(path)
                self.answer("application/pdf", b"%PDF", 200 if asked.count(path) > 2 else 502)
            elif path == "/down":
                self.answer("application/json", {}, 503)
            elif path == "/nothing":
                self.answer("application/json", {}, 404)
            elif path == "/broken":
                self.answer("application/json", {"error": "no"}, 500)
            elif path == "/binary":
                self.answer("image/png", b"x" * 7)
            elif path == "/bare":
                self.answer("", b"plain")
            elif path.startswith("/clients/"):
                _, _, client, part = path.split("/")
                if self.headers.get("Authorization") != "Bearer secret" or client == "gone":
                    self.answer("application/json", {}, 404)
                elif part == "label":
                    self.answer("application/json", [1] if client == "list" else {"cin": client})
                else:
                    self.answer("image/jpeg", b"picture") if part == "recto" else self.answer("application/json", {"url": "/doc/verso"}) if client == "named" else self.answer("application/pdf", b"%PDF")
            else:
                self.answer("application/json", {"path": self.path, "models": [{"name": "m1"}]})

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            text = f"```markdown\n{asked['messages'][-1]['images'][0]}\n```"
            self.answer("application/json", {"message": {"content": text, "thinking": "hm"}, "prompt_eval_count": 11, "eval_count": 30, "eval_duration": 2_000_000_000})

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_rest(spark, server, tmp_path):
    rows = rest.json_pages(spark, f"{server}/list", 3).orderBy("page").collect()
    assert [json.loads(r.body)["path"] for r in rows] == [f"/list?page={i}" for i in (1, 2, 3)]
    assert rest.json_pages(spark, "http://127.0.0.1:9/x").first().error is not None
    assert rest.download(f"{server}/doc", str(tmp_path / "d")).endswith(".pdf")
    with pytest.raises(ValueError):
        rest.download(f"{server}/json", str(tmp_path / "e"))
    assert [r.name for r in rest.model_names(spark, server).collect()] == ["m1"]
    assert rest.model_names(spark, "http://127.0.0.1:9").count() == 0


def test_listings_go_on_until_the_last_page(spark, server):
    rows = rest.json_pages(spark, f"{server}/numbered").orderBy("page").collect()
    assert [json.loads(r.body) for r in rows] == [[1], [2], [3]]
    rows = rest.json_pages(spark, f"{server}/tokens", token_field="next").orderBy("page").collect()
    assert [json.loads(r.body)["files"] for r in rows] == [[0], [1], [2]]
    assert [(r.status, r.error) for r in rest.json_pages(spark, f"{server}/broken").collect()] == [(500, None)]


def test_bodies_proxies_and_certificates(spark, server):
    row = rest.json_pages(spark, f"{server}/binary", 1).first()
    assert (row.kind, row.bytes, row.body) == ("image/png", 7, None)
    row = rest.json_pages(spark, f"{server}/bare", 1).first()
    assert (row.kind, row.body) == ("none", "plain")
    # through the server itself as a proxy the path is the whole address
    seen = json.loads(rest.json_pages(spark, "http://other.test/list", 1, proxy=server).first().body)
    assert seen["path"] == "http://other.test/list?page=1"
    assert json.loads(rest.json_pages(spark, "http://other.test/list", 1, proxy=f"https=x:1;http={server}").first().body)["path"].startswith("http://other.test")
    with pytest.raises(ValueError):
        rest.get(server, timeout=0)
    strict, loose = (next(h for h in rest.opener(verify=v).handlers if type(h).__name__ == "HTTPSHandler")._context for v in (True, False))
    assert strict.check_hostname and not loose.check_hostname


def test_whole_bodies_and_listings_that_never_end(spark, server):
    long = rest.json_pages(spark, f"{server}/long", 1).first()
    assert (len(long.body), long.bytes) == (100_000, 250_002)
    assert len(rest.json_pages(spark, f"{server}/long", 1, most_text="0").first().body) == 250_002
    assert [json.loads(r.body) for r in rest.json_pages(spark, f"{server}/same").collect()] == [["same"]]
    assert rest.json_pages(spark, f"{server}/endless", most_pages="4").count() == 4
    assert rest.json_pages(spark, f"{server}/stuck", token_field="next").count() == 2
    assert "ValueError" in rest.json_pages(spark, f"{server}/list", 1, timeout="0").first().error


def test_documents_are_fetched_by_tasks(spark, server, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("a", f"{server}/doc/1"), ("a", f"{server}/doc/1"), ("b", f"{server}/list"), ("c", f"{server}/flaky/c"), ("d", f"{server}/down"), ("e", "http://127.0.0.1:9/x"), ("../f", f"{server}/doc/2"), ("g", f"{server}/nothing")], "name string, url string")
    got = {r.name: r for r in rest.download_all(rows, "shop://docs", pause=0.01, opened=shop(tmp_path)).collect()}
    assert (got["a"].path, got["a"].tries) == ("shop://docs/a.pdf", 1) and (tmp_path / "docs" / "a.pdf").read_bytes() == b"%PDF"
    assert "unsupported" in got["b"].error and got["b"].tries == 1
    assert got["c"].path == "shop://docs/c.pdf" and got["c"].tries == 3
    assert "503" in got["d"].error and got["d"].tries == 3 and got["e"].tries == 3 and got["../f"].error == "unsafe name" and "404" in got["g"].error and got["g"].tries == 1
    assert sorted(p.name for p in (tmp_path / "docs").iterdir()) == ["a.pdf", "c.pdf"]
    monkeypatch.setattr(rest, "MOST_BYTES", 3)
    with pytest.raises(ValueError, match="too large"):
        rest.download(f"{server}/doc", str(tmp_path / "big"))
    assert not list(tmp_path.glob("*big*"))
    with pytest.raises(RuntimeError):
        rest.download_all(rows, "shop://docs", token_variable="NO_SUCH_VARIABLE")


def test_targets_must_be_shared():
    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://x:7077"

        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: "file:///shared/points" if "checkpoint" in name else default)

    assert taskfiles.checked_target(Session, "s3://bucket/x/") == "s3://bucket/x"
    assert taskfiles.checked_target(Session, "/shared/points/out") == "/shared/points/out"
    for own in ("/tmp/x", "file:///tmp/x", "/shared/points-not"):
        with pytest.raises(ValueError, match="one machine"):
            taskfiles.checked_target(Session, own)


def test_a_listing_as_a_stream_goes_on_where_it_was(spark, server, tmp_path):
    spark.dataSource.register(rest.JsonPages)
    asked.clear()

    def run(batches):
        stream = spark.readStream.format("json_pages").option("url", f"{server}/growing").option("token_field", "next").load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="100 milliseconds").start()
        until = time.monotonic() + 60
        while time.monotonic() < until and spark.read.schema("page int").parquet(str(tmp_path / "out")).count() < batches if (tmp_path / "out").exists() else time.monotonic() < until:
            time.sleep(0.1)
        query.stop()
        return sorted(r.page for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = run(3)
    assert first[:3] == [1, 2, 3] and len(first) == len(set(first))
    count = len(asked)
    second = run(6)
    assert second == [1, 2, 3, 4, 5, 6] and "page_token=0" not in asked[count:] and "" not in asked[count:]


def test_import_of_clients(spark, server, tmp_path, monkeypatch):
    api = rest.ClientApi(server, "/clients/{client_id}/recto", "clients/{client_id}/verso", "clients/{client_id}/label", token_variable="TEST_SECRET")
    clients = spark.createDataFrame([(" c1 ",), ("",), (None,), ("c1",), ("../x",), ("gone",), ("list",)], "client_id string")
    monkeypatch.delenv("TEST_SECRET", raising=False)
    with pytest.raises(RuntimeError):
        rest.import_clients(clients, api, str(tmp_path))
    monkeypatch.setenv("TEST_SECRET", "secret")
    rows = {r.client_id: r for r in rest.import_clients(clients, api, str(tmp_path)).collect()}
    assert set(rows) == {"c1", "../x", "gone", "list"} and rows["../x"].issue == "client_id_invalid"
    assert rows["c1"].status == "ready" and open(rows["c1"].recto_source, "rb").read() == b"picture" and rows["c1"].verso_source.endswith("c1_verso.pdf")
    assert json.load(open(rows["c1"].label_path)) == {"cin": "c1"}
    assert "404" in rows["gone"].issue and "JSON object" in rows["list"].issue
    named = rest.ClientApi(server, "doc/recto", "clients/{client_id}/verso", "clients/{client_id}/label", document_key="url", token_variable="TEST_SECRET")
    row = rest.import_clients(spark.createDataFrame([("named",)], "client_id string"), named, str(tmp_path)).first()
    assert row.status == "failed" and row.issue  # the recto answer is no JSON
    named.recto = named.verso
    assert rest.import_clients(spark.createDataFrame([("named",)], "client_id string"), named, str(tmp_path)).first().status == "ready"


def test_adapters_over_http_and_of_packages(spark, server, tmp_path):
    registry = inference.default_registry(server)
    scan = tmp_path / "1.png"
    scan.write_bytes(b"\x89PNG\0pixels")
    rows = spark.createDataFrame([(1, str(scan))], "case_id long, image_path string")
    row = inference.infer(rows, "http:llava:7b", registry).first()
    # the server answers with what it was sent
    assert (base64.b64decode(row.text), row.reasoning, row.input_tokens, row.output_tokens, row.tokens_per_second, row.status) == (b"\x89PNG\0pixels", "hm", 11, 30, 15.0, "success")
    content = spark.read.format("binaryFile").load(str(scan)).select(F.lit(2).alias("case_id"), F.lit("nowhere.png").alias("image_path"), "content")
    assert base64.b64decode(inference.infer(content, "http:llava:7b", registry).first().text) == b"\x89PNG\0pixels"
    assert inference.infer(rows, "http:x", inference.default_registry("http://127.0.0.1:9")).first().status == "failed"
    lost = spark.createDataFrame([(1, str(tmp_path / "2.png"))], "case_id long, image_path string")
    assert "FileNotFoundError" in inference.infer(lost, "http:x", registry).first().error
    assert inference.infer(rows, "local:posixpath:basename", registry).first().text == "1.png"
    assert "ModuleNotFoundError" in inference.infer(rows, "local:no_such_package", registry).first().error
    assert inference.unfenced("```json\nx\n```") == "```json\nx\n```"


def sleeper(seconds):
    """A registry of a model that sleeps as long as its case says, or ``seconds``."""

    class Sleeper(inference.Adapter):
        def perform(self, case):
            time.sleep(case.get("wait", seconds))
            if case.get("wait") == 0.5:
                raise RuntimeError("late error")
            return {"text": f"read {case['case_id']}", "latency": 0.0}

    registry = inference.Registry()
    registry.register("slow", lambda name: Sleeper())
    return registry


def test_a_deadline_ends_a_case_and_its_answer_is_a_late_trace(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.0), (2, 3.0), (3, 0.0), (4, 0.5), (5, 0.0)], "case_id long, wait double").coalesce(1)
    began = time.monotonic()
    counted, trace = inference.run(rows, "slow:x", sleeper(0), str(tmp_path / "run"), timeout=0.3, linger=20.0)
    assert time.monotonic() - began < 20
    assert {r.case_id: (r.status, r.text, r.timing) for r in counted.collect()} == {1: ("success", "read 1", "on_time"), 2: ("timeout", None, "timeout"), 3: ("success", "read 3", "on_time"), 4: ("timeout", None, "timeout"), 5: ("success", "read 5", "on_time")}
    late = {r.case_id: (r.status, r.text, r.error) for r in trace.where(F.col("timing") == inference.LATE).collect()}
    assert late == {2: ("success", "read 2", None), 4: ("failed", None, "RuntimeError: late error")}


def test_calls_that_hang_hold_no_partition(spark):
    """Two calls hang for a minute: their cases end in time, the next wait for no more than a deadline, and nothing waits for the calls."""
    rows = spark.range(1, 6).select(F.col("id").alias("case_id"), F.when(F.col("id") < 3, 60.0).otherwise(0.0).alias("wait")).coalesce(1)
    began = time.monotonic()
    got = {r.case_id: r for r in inference.infer(rows, "slow:x", sleeper(0), timeout=0.5, linger=0.2, most_overdue=2).collect()}
    assert time.monotonic() - began < 20
    assert [got[i].status for i in range(1, 6)] == ["timeout", "timeout", "failed", "failed", "failed"] and "not called" in got[3].error
    began = time.monotonic()
    side = inference.infer(rows.where("case_id > 2").withColumn("wait", F.lit(1.0)), "slow:x", sleeper(0), timeout=5.0, at_once=3).collect()
    assert {r.status for r in side} == {"success"} and time.monotonic() - began < 2.9


def test_model_boundary(spark):
    class Broken(inference.Adapter):
        def perform(self, case):
            raise RuntimeError("no")

    registry = inference.mock_registry()
    registry.register("broken", lambda name: Broken())
    with pytest.raises(ValueError):
        registry.register("mock", lambda name: Broken())
    with pytest.raises(KeyError):
        registry.factory("other:x")
    rows = spark.createDataFrame([(1, "some text here")], "case_id long, ground_truth string")
    bad = inference.infer(rows, "broken:x", registry).first()
    assert bad.status == "failed" and "RuntimeError" in bad.error and bad.text is None
    assert inference.infer(rows, "mock:1/0", registry).first().text == "some text here"
    assert [(r.status, r.timing, r.text) for r in inference.infer(rows, "mock:1/0", registry, timeout=0.1).collect()] == [("timeout", "timeout", None), ("success", inference.LATE, "some text here")]
    assert inference.infer(rows, "mock:1/0", registry, timeout=0).first().status == "success"


@pytest.mark.parametrize("part_rows", [9, 10**6])
def test_running_sums_of_skewed_and_null_orders(spark, part_rows):
    """One group with most rows, one number with a third of them, groups and numbers that are null: every row comes back."""
    r = random.Random(3)
    rows = [("a", i * i, i, r.choice([None, 1, 2, 5])) for i in range(200)] + [("a", 10**9, 300 + i, 1) for i in range(120)] + [("b", 7, 0, 3), ("c", 50_000, 1, None)]
    rows += [(None, r.choice([None, 1, 2]), 400 + i, 2) for i in range(40)] + [("d", None, 500, 4), ("d", 3, 501, None)]
    df = spark.createDataFrame(rows, "g string, o long, id long, v long").repartition(5)
    found = summary.running_sums(df, ["g"], "o", {"s": F.col("v"), "n": F.lit(1)}, part_rows=part_rows).collect()
    assert sorted(x.id for x in found) == sorted(x[2] for x in rows)
    by = collections.defaultdict(list)
    for x in sorted(found, key=lambda x: x.n):
        by[x.g].append(x)
    for own in by.values():
        assert [x.n for x in own] == list(range(1, len(own) + 1))
        order = [(x.o is None, x.o or 0) for x in own]
        assert order == sorted(order)
        for i, x in enumerate(own):
            there = [y.v for y in own[: i + 1] if y.v is not None]
            assert x.s == (sum(there) if there else None)
    assert summary.running_sums(df.limit(0), ["g"], "o", {"s": F.col("v")}, part_rows=part_rows).count() == 0


def test_ranges_are_balanced(spark, tmp_path):
    """A group and a number with nearly all rows fill many ranges: no task sums over twice its share."""
    df = spark.range(40_000).selectExpr("if(id % 50 = 0, id, 7) as g", "if(id % 3 = 0, null, if(id % 3 = 1, 5, id)) as o", "1 as v")
    out = ordered.running_sums(df, ["g"], "o", {"s": F.col("v")}, part_rows=2000)
    assert out.agg(F.max("s")).first()[0] == 39_200
    ranged = [x for x in Path(re.sub("^file:", "", spark.conf.get("spark.checkpoint.dir"))).glob("kept-*") if "place_" in spark.read.parquet(str(x)).columns]
    sizes = [r["count"] for x in ranged for r in spark.read.parquet(str(x)).groupBy(F.shiftright("place_", 33)).count().collect() if spark.read.parquet(str(x)).count() == 40_000]
    assert len(sizes) > 15 and max(sizes) <= 4000


def test_large_keys_are_numbered_in_ranges(spark, monkeypatch):
    """Duplicates, neighbours and pages where one key has nearly all rows: as with one window, with null keys kept."""
    rows = [("a", f"p{i % 70:03d}") for i in range(200)] + [(None, "x"), (None, "y"), ("b", None), ("b", "z")]
    df = spark.createDataFrame(rows, "k string, path string").repartition(3)
    few = collections.Counter((r.k, r.path, r.duplicate) for r in views.duplicates(df, ["k"], "path").collect())
    steps = spark.range(300).selectExpr("id as seq", "if(id < 290, 'a', null) as client")
    near = {r.seq: (r.next, r.previous) for r in views.neighbours(steps, "client", "seq").collect()}
    whole = ordered.running_sums
    monkeypatch.setattr(views, "running_sums", lambda *a: whole(*a, part_rows=20))
    assert collections.Counter((r.k, r.path, r.duplicate) for r in views.duplicates(df, ["k"], "path").collect()) == few
    assert few["a", "p000", False] == 1 and few["a", "p000", True] == 2 and few[None, "x", False] == few[None, "y", True] == few["b", "z", False] == few["b", None, True] == 1
    assert {r.seq: (r.next, r.previous) for r in views.neighbours(steps, "client", "seq").collect()} == near
    assert near[0] == (1, 0) and near[5] == (6, 4) and near[289] == (289, 288) and near[290] == (1, 0) and near[299] == (9, 8)


def test_running_views_keep_null_models(spark):
    rows = [("a", 1, "success", 1.0, 0.5), (None, 2, "failed", 2.0, None), ("a", None, "success", 3.0, 0.7), (None, 4, "success", 4.0, 0.9)]
    df = spark.createDataFrame(rows, "model string, seq long, status string, latency double, accuracy double")
    got = {(r.model, r.seq): r for r in summary.running_summary(df).collect()}
    assert {k: r.documents for k, r in got.items()} == {("a", 1): 1, ("a", None): 2, (None, 2): 1, (None, 4): 2}
    assert {(r.model, r.seq): (r.done, r.total) for r in summary.progress(df, ["model"]).collect()} == {("a", 1): (1, 2), ("a", None): (2, 2), (None, 2): (1, 2), (None, 4): (2, 2)}
    assert {(r.model, r.seq) for r in summary.until_errors(df, ["model"], 1).collect()} == {("a", 1), ("a", None), (None, 2)}


@pytest.mark.parametrize("few, bins", [(100_000, 2048), (3, 4), (1, 2)])
def test_quantiles_match_plain_ones(spark, few, bins):
    r = random.Random(4)
    values = {"a": [r.randint(0, 30) / 7 for _ in range(101)], "b": [2.5], "c": [1.0, 9.0], "d": [3.0] * 8, None: [r.uniform(-1, 1) * 10 ** r.randint(-9, 9) for _ in range(60)]}
    values |= {"e": [0.0, -0.0, 5e-324, -1e308, 1e308, 1e-300], "f": [1.0 + i * 2.0**-52 for i in range(9)], "g": [1.0] * 50 + [1e9], "h": [-math.inf, 1.0, math.inf]}
    df = spark.createDataFrame([(g, v) for g, x in values.items() for v in x] + [("a", None), ("z", None)], "g string, v double").repartition(3)
    shares = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {x.g: x for x in summary.quantiles(df, "g", "v", shares, few=few, bins=bins).collect()}
    assert set(got) == set(values)
    for g, x in values.items():
        for n, p in shares.items():
            at, x = p * (len(x) - 1), sorted(x)
            low, high = x[math.floor(at)], x[math.ceil(at)]
            assert got[g][n] == pytest.approx(low if low == high else low + (high - low) * (at - math.floor(at)), rel=1e-12, nan_ok=True)
    assert summary.quantiles(df.limit(0), "g", "v", shares).count() == 0


def test_an_outlier_moves_no_values_into_one_task(spark):
    """A million latencies and one of 1e9: the last bracket holds few of them."""
    df = spark.range(1_000_000).selectExpr("'m' as g", "if(id = 7, 1e9D, 1 + (id * 7919 % 1000003) / 1e6D) as v")
    values = ordered.kept(df.select(F.col("g").alias("g_"), F.col("v").alias("v_")))
    targets = spark.createDataFrame([("m", 499_999), ("m", 950_000)], "g_ string, k_ long")
    sizes = []
    spied = ordered.within
    try:
        ordered.within = lambda v, b, n: (sizes.append(max(r["count"] for r in spied(v, b, n).groupBy("lo_").count().collect())), spied(v, b, n))[1]
        got = {r.k_: r.v_ for r in ordered.selected(values, targets, 20_000, 2048).collect()}
    finally:
        ordered.within = spied
    whole = sorted(r[0] for r in df.select("v").collect())
    assert got == {k: whole[k] for k in (499_999, 950_000)} and sizes[-1] <= 20_000


def plain_search(ratio):
    best, score = 0, math.inf
    for step in range(2):
        for angle in range(-90, 91, 6) if step == 0 else range(best - 5, best + 6):
            if (r := ratio(angle)) is not None and abs(r - measures.CARD) < score:
                best, score = angle, abs(r - measures.CARD)
        coarse = best if step == 0 else coarse
    return best, coarse, score


def test_angles_are_searched_in_two_steps(spark):
    tables = [{a: None if (a * 7 + k) % 5 == 0 else round(1.4 + ((a * 37 + k * 11) % 40) / 100, 2) for a in range(-100, 101)} for k in range(8)] + [{}, {0: 1.586}, {-2: None, 3: 1.6, 4: 1.6}]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tables)], "id int, ratios map<int, double>")
    ratio = lambda a: F.try_element_at("ratios", a)
    for row in df.select("id", measures.searched_angle(ratio).alias("f"), measures.best_angle(range(-5, 6), ratio).alias("one")).collect():
        best, coarse, score = plain_search(tables[row.id].get)
        assert (row.f.angle, row.f.coarse_angle) == (best, coarse) and row.f.off == pytest.approx(score)
        known = [(abs(r - measures.CARD), a) for a in range(-5, 6) if (r := tables[row.id].get(a)) is not None]
        assert row.one == (min(known)[1] if known else 0)


def test_reports_and_tables_are_whole(spark, tmp_path):
    failures = spark.range(12_000).selectExpr("'m' as model", "concat('i', id) as image_path", "'failed' as status")
    sinks.save_report(spark.createDataFrame([("m", 0.5)], "model string, quality double"), failures, str(tmp_path / "r"))
    lines = [x.rstrip("\n") for p in sorted((tmp_path / "r").glob("part-*")) for x in open(p)]
    assert lines[0] == "# Report" and lines[4] == "| m | 0.5000 |" and len(lines) == 8 + 12_000 and lines[8].startswith("- m i0: failed")
    pages = sinks.html_table(spark.range(25).selectExpr("1 as k", "id"), "k", ["id"], page_rows=10).collect()
    assert sorted((p.page, p.html.count("<tr>")) for p in pages) == [(1, 10), (2, 10), (3, 5)]


def test_quotas_beyond_the_broadcast(spark, monkeypatch):
    rows = spark.range(60).selectExpr("id", "id % 3 as g")
    quotas = spark.createDataFrame([(0, 4), (1, 100)], "g long, requested int")
    few = {(r.g, r.id) for r in selection.sample_by(rows, quotas, 42, "id", "g").collect()}
    monkeypatch.setattr(selection, "MOST_QUOTAS", 1)
    assert {(r.g, r.id) for r in selection.sample_by(rows, quotas, 42, "id", "g").collect()} == few and len(few) == 24


def test_streams_stop_after_errors_and_keep_what_is_known(spark, tmp_path):
    for batch in ([("a", 1, "success"), ("a", 2, "failed"), ("b", 3, "failed")], [("a", 4, "timeout"), ("a", 5, "success"), ("b", 6, "success")]):
        spark.createDataFrame(batch, "run string, seq long, status string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("run string, seq long, status string").parquet(str(tmp_path / "in"))
        out = live.to_table(spark, live.until_errors(stream, "run", "seq", 2), "append", str(tmp_path / "s"))
    assert sorted((r.run, r.seq) for r in out.collect()) == [("a", 1), ("a", 2), ("a", 4), ("b", 3), ("b", 6)]
    spark.createDataFrame([(1, 1, "x", 5.0), (1, 2, None, 6.0)], "id long, seq long, note string, v double").write.parquet(str(tmp_path / "q"))
    state = live.queue_state(spark.readStream.schema("id long, seq long, note string, v double").parquet(str(tmp_path / "q")), "id", "seq", ["note", "v"])
    assert tuple(live.to_table(spark, state, "complete", str(tmp_path / "t")).first()) == (1, "x", 6.0)


def test_late_answers_change_no_score(spark, tmp_path):
    spark.createDataFrame([(1, "a", 0.5, 0.9), (2, "a", 5.0, 0.8)], "seq long, model string, latency double, score double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq long, model string, latency double, score double").parquet(str(tmp_path / "in"))
    scored, _ = live.split_late(stream, 1.0)
    row = live.to_table(spark, live.running_summary(scored), "complete", str(tmp_path / "s")).first()
    assert (row.documents, row.success, float(row.score)) == (2, 1, 0.9)


def test_a_cutoff_over_shuffled_batches_is_that_of_the_batch_query(spark, tmp_path):
    r, day = random.Random(7), 1_700_000_000
    rows = [(r.choice("abc"), i, day + i, r.choice(["success", "success", "failed"])) for i in range(120)]
    frame = spark.createDataFrame(rows, "run string, seq long, t long, status string")
    want = {(x.run, x.seq) for x in summary.until_errors(frame, ["run"], 4).collect()}
    order = sorted(rows, key=lambda x: x[1] + r.uniform(-15, 15))
    # a run without a name, a row without a number, one without a time; one far too late; and one that ends the stream
    order = [(None, 1, day, "failed"), (None, None, day + 1, "success"), *order[:60], ("d", 1, None, "success"), *order[60:], ("end", 0, day + 10_000, "success"), ("end", 1, day + 10_000, "success")]
    for i in range(0, len(order), 25):
        part = spark.createDataFrame(order[i : i + 25], "run string, seq long, t long, status string").withColumn("t", F.timestamp_seconds("t"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    stream = spark.readStream.schema("run string, seq long, t timestamp, status string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = live.to_table(spark, live.until_errors_unordered(stream, "run", "seq", "t", "60 seconds", 4), "append", str(tmp_path / "s")).collect()
    assert {(x.run, x.seq) for x in out if x.run in ("a", "b", "c")} == want and {x.verdict for x in out} == {"counted"}
    assert {(x.run, x.seq) for x in out if x.run not in ("a", "b", "c", "end")} == {(None, 1), (None, None), ("d", 1)}


def test_archives_are_listed_once_and_opened_by_few_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "TASK_BYTES", 4000)
    for n in range(8):
        with zipfile.ZipFile(tmp_path / f"{n}.zip", "w") as z:
            for i in range(40):
                z.writestr(f"{i}.txt", f"{n} {i}".ljust(100))
    made = tmp_path / "made"
    made.mkdir()

    def make(batches):
        for batch in batches:
            for path in batch["path"]:
                (made / uuid.uuid4().hex).touch()
                yield pd.DataFrame({"path": [path]})

    paths = spark.createDataFrame([(f"{tmp_path}/{n}.zip",) for n in range(8)], "path string").mapInPandas(make, "path string")
    found = archives.dealt(archives.members(paths))
    parts = found.select("archive", "member", F.spark_partition_id().alias("part")).collect()
    assert len(list(made.iterdir())) == 8 and len({(r.archive, r.member) for r in parts}) == 320
    # eight parts: each archive lies in four runs of ten entries, not in every part
    assert found.rdd.getNumPartitions() == 8 and len({(r.archive, r.part) for r in parts}) <= 8 * 4
    listed = archives.members(paths)
    got = {(r.archive[-5:-4], r.member): bytes(r.content).decode().strip() for r in archives.contents(listed).collect()}
    assert got == {(str(n), f"{i}.txt"): f"{n} {i}" for n in range(8) for i in range(40)}


class Kept:
    """A state of a stream in memory."""

    def __init__(self):
        self.rows, self.reads = [], 0

    def exists(self):
        return bool(self.rows)

    def get(self):
        self.reads += 1
        return self.rows[0] if self.single else iter(self.rows)

    def update(self, row):
        self.rows = [row]

    def appendValue(self, row):
        self.rows.append(row)

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def state(self, name, single):
        self.states[name] = Kept()
        self.states[name].single = single
        return self.states[name]

    def getListState(self, name, kind):
        return self.state(name, False)

    def getValueState(self, name, kind):
        return self.state(name, True)

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, now):
        self.getCurrentWatermarkInMs = lambda: now


def test_a_cutoff_without_order_sets_no_timer_for_each_row():
    kinds = StructType().add("run", "string").add("seq", "long").add("status", "string").add("due_", "long")
    cut, handle = live.OrderedCutoff(kinds, "run", "seq", 3), Handle()
    cut.init(handle)
    # numbers beyond 2**53 beside a row without one; every third row fails
    base = 1 << 60
    rows = [Row(run=r, seq=base + i, status="failed" if i % 3 == 0 else "success", due_=i * 1000) for r in "ab" for i in range(500)]
    rows.append(Row(run="c", seq=None, status="success", due_=5000))
    random.Random(3).shuffle(rows)
    assert list(cut.handleInputRows((0,), iter(rows), Clock(0))) == [] and len(handle.timers) == 1
    told = [r for _ in range(3) for r in cut.handleExpiredTimer((0,), Clock(4), None)]
    assert sorted((r.run, r.seq - base, r.verdict) for r in told) == [(r, i, "counted") for r in "ab" for i in range(5)]
    assert handle.states["waiting"].reads == 1 and handle.timers[1:] == [5]
    told = list(cut.handleExpiredTimer((0,), Clock(10_000), None))
    assert sorted((r.run, r.seq and r.seq - base) for r in told) == [("a", 5), ("a", 6), ("b", 5), ("b", 6), ("c", None)]
    assert not handle.states["waiting"].exists()
    late = [Row(run="a", seq=base + 700, status="success", due_=0), Row(run="c", seq=base + 1, status="success", due_=0)]
    assert list(cut.handleInputRows((0,), iter(late), Clock(10_000))) == [] and handle.timers[-1] == 10_001
    assert [tuple(r) for r in cut.handleExpiredTimer((0,), Clock(10_001), None)] == [("c", base + 1, "success", 0, "counted")]


def test_import_states_follow_the_rules(spark, tmp_path):
    told = [
        ("a", 1, "discovered", "accepted", "discovered"), ("a", 2, "downloaded", "illegal", "discovered"), ("a", 3, "documents_detected", "accepted", "documents_detected"),
        ("a", 3, "documents_detected", "repeated", "documents_detected"), ("a", 4, "downloaded", "accepted", "downloaded"), ("a", 2, "failed", "repeated", "downloaded"),
        ("a", 5, "ready_without_label", "accepted", "ready_without_label"), ("a", 6, "nonsense", "illegal", "ready_without_label"), ("a", 7, "discovered", "accepted", "discovered"),
        ("b", 1, "failed", "accepted", "failed"), ("b", None, "discovered", "repeated", "failed"), ("b", 2, None, "illegal", "failed"), (None, 1, "ready", "illegal", ""),
    ]
    for batch in (told[:5], told[5:]):
        spark.createDataFrame([x[:3] for x in batch], "client string, seq long, status string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("client string, seq long, status string").parquet(str(tmp_path / "in"))
        out = live.to_parted_table(spark, live.import_states(stream, "client", "seq", "status"), "verdict", str(tmp_path / "s"))
    assert collections.Counter(map(tuple, out.select("client", "seq", "status", "verdict", "state").collect())) == collections.Counter(told)
    assert sorted(p.name for p in (tmp_path / "s" / "out").glob("*/verdict=*"))[0] == "verdict=accepted"


ENTRY = "image_path string, category string, ground_truth string, bytes long"


def test_appends_at_once_lose_nothing(spark, tmp_path):
    path, errors = str(tmp_path / "c"), []

    def append(i):
        try:
            sinks.append_catalog(spark.createDataFrame([(f"{i}.png", "x", "t", 5), (f"{i}b.png", "x", "t", 5)], ENTRY), path)
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=append, args=(i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    read = lambda v=None: sorted(r.image_path for r in sinks.read_catalog(spark, path, "image_path string", v).collect())
    assert not errors and read() == sorted(f"{i}{b}.png" for i in range(6) for b in ("", "b"))
    assert [len(read(v)) for v in range(1, 7)] == [2, 4, 6, 8, 10, 12] and sinks.latest_version(sinks.Store(spark, path)) == 6
    assert sorted(p.name for p in (tmp_path / "c" / "_versions").iterdir() if not p.name.endswith(".crc")) == [f"{i:012d}.json" for i in range(1, 7)]


def test_a_failed_append_leaves_nothing(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "c"), spark.createDataFrame([("a.png", "x", "t", 5)], ENTRY)
    assert sinks.read_catalog(spark, path, "image_path string").count() == 0
    sinks.append_catalog(rows, path)
    broken = rows.withColumn("image_path", F.when(F.col("bytes") == 5, F.raise_error(F.lit("no"))).otherwise("a.png"))
    with pytest.raises(Exception, match="no"):
        sinks.append_catalog(broken, path)
    monkeypatch.setattr(sinks.Store, "create", lambda *a: False)
    with pytest.raises(OSError, match="changed"):
        sinks.append_catalog(rows, path)
    monkeypatch.setattr(sinks.Store, "create", lambda *a: (_ for _ in ()).throw(RuntimeError("gone")))
    with pytest.raises(RuntimeError):
        sinks.append_catalog(rows, path)
    assert sinks.read_catalog(spark, path, "image_path string").count() == 1
    assert len([p for p in (tmp_path / "c").iterdir() if not p.name.startswith(".")]) == 2


def test_a_run_is_published_whole_or_not_at_all(spark, tmp_path):
    path = tmp_path / "runs" / "r1"
    results = spark.range(100).selectExpr("id as seq", "concat('m', id % 2) as model", "concat('/i', id, '.png') as image_path", "if(id % 7 = 0, 'failed', 'success') as status", "if(id = 3, null, id / 3) as score", "array(id) as boxes").repartition(5)
    totals = results.groupBy("model").agg(F.avg("score").alias("score"))
    sinks.save_whole_run(results, totals, str(path))
    mark = runs.read_run(str(path))
    assert (mark["rows"], mark["failures"]) == (100, 15) and all((path / f).exists() for f in mark["files"])
    assert sorted(r.seq for r in spark.read.json(str(path / "results")).collect()) == list(range(100))
    details = spark.read.option("header", True).csv(str(path / "details"))
    assert details.count() == 100 and details.where("seq = 3").first().score is None
    report = "".join(p.read_text() for p in sorted((path / "report").glob("*.md")))
    assert report.startswith("# Report\n\n| model | score |") and report.count("\n- m") == 15 and "- m0 /i14.png: failed" in report
    assert (path / "summary.csv").read_text().startswith("model,score")
    with pytest.raises(Exception, match="there already"):
        sinks.save_whole_run(results, totals, str(path))
    sinks.save_whole_run(results.where("seq < 10"), totals, str(path), overwrite=True)
    assert runs.read_run(str(path))["rows"] == 10
    # a task fails for good: neither a run nor a staged folder is left
    broken = results.withColumn("status", F.when(F.col("seq") == 50, F.raise_error(F.lit("killed"))).otherwise("success"))
    with pytest.raises(Exception, match="killed"):
        sinks.save_whole_run(broken, totals, str(tmp_path / "runs" / "r2"))
    assert [p.name for p in (tmp_path / "runs").iterdir()] == ["r1"]
    sinks.save_whole_run(results.limit(0), totals.limit(0), str(tmp_path / "runs" / "empty"))
    assert runs.read_run(str(tmp_path / "runs" / "empty"))["rows"] == 0
