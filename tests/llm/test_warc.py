import base64
import hashlib

from rubrica.llm import warc

PAGE = "page_id long, url string, html string"


def expected(rows, least=0):
    seen, out = {}, []
    for k, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (h or "").encode()
        first = seen.setdefault(b, k) if len(b) >= least else k
        again = len(b) >= least and first != k
        out.append((k, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first if again else None))
    return out


def run(spark, rows, least=0):
    out = warc.revisit_archives(spark, spark.createDataFrame(rows, PAGE), least).collect()
    assert all(r.digest_ok for r in out)
    return sorted([(r.row_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out], key=lambda r: (r[0] is None, r[0] or 0))


def test_copies_revisit_the_smallest_id_and_payloads_survive(spark):
    rows = [(5, "http://a", "same"), (2, "http://b", "same"), (9, None, "same"), (3, "http://c", None), (4, "", ""), (7, "u\r\nx: y", "é\r\n\r\nbody"), (8, "http://d", "x" * 300_000), (10, "http://e", "x" * 300_000)]
    assert run(spark, rows) == expected(rows)
    assert run(spark, rows, 5) == expected(rows, 5)


def test_null_ids_and_repeated_rows_have_records_of_their_own(spark):
    rows = [(None, "u", "t"), (1, "u", "t"), (1, "u", "t"), (2, "u", "z"), (2, "u", "z")]
    out = run(spark, rows)
    assert len(out) == 5
    assert [r[3] for r in out].count("response") == 2 and out[-1][3:] == ("revisit", 1)
    assert run(spark, []) == []


def test_archives_roll_over_and_headers_are_fresh(spark, tmp_path):
    folder, to = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    df = spark.createDataFrame([(i, f"http://h/{i}", f"page {i // 2}" * 50) for i in range(40)], PAGE).coalesce(1)
    index = df.sparkSession.createDataFrame(warc.write_archives(df, folder, roll_bytes=2000).collect(), warc.INDEX)
    assert index.select("file").distinct().count() > 2
    files = warc.deduplicate(warc.resolve(index), folder, to).collect()
    assert sum(f.records for f in files) == 40
    first = [h for f in files for h, _ in warc.records_in(f"{to}/{f.file}") if h["WARC-Type"] == "revisit"][0]
    assert first["WARC-Profile"] == warc.REVISIT_PROFILE and first["WARC-Refers-To"].startswith("<urn:uuid:") and first["WARC-Refers-To-Target-URI"].startswith("http://h/")
