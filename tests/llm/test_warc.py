import hashlib

from tessera.llm import warc
from tessera.llm.tables import shared_folder

BIG = "<p>é" + "x" * 1200
ROWS = [
    (1, "http://a.example/1", BIG), (2, "http://a.example/2", BIG), (9, "http://a.example/9", BIG), (3, None, None), (4, "http://b/", ""), (5, "http://b/", "tiny"), (6, "http://c/", "tiny"),
    (7, "http://d/", "y" * 999), (8, "http://d/", "y" * 999), (10, "http://e/", "z" * 1000), (11, "http://e/", "z" * 1000), (11, "http://e/", "z" * 1000), (None, "http://f/", BIG), (None, "http://g/", "q" * 1500), (12, "http://h/", "w" * 500_000),
]
SCHEMA = "page_id long, url string, html string, digest string, header binary, n int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", b"y", 1) for r in rows], SCHEMA)


def expected(rows):
    out = []
    for p, _, h in rows:
        body = (h or "").encode()
        ids = [q for q, _, g in rows if (g or "") == (h or "") and q is not None]
        owner = max(ids, default=None)
        again = len(body) >= 1000 and owner is not None and p != owner
        out.append((p, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", owner if again else None))
    return sorted(out, key=str)


def test_listing_with_edge_cases(spark):
    got = warc.archived(pages(spark, ROWS)).collect()
    assert sorted(map(tuple, got), key=str) == expected(ROWS)
    assert warc.archived(pages(spark, [])).count() == 0


def test_exact_round_trip(spark):
    folder = shared_folder(spark)
    warc.write(pages(spark, ROWS), folder)
    assert spark.read.parquet(f"{folder}/payloads").count() == len({(h or "") for _, _, h in ROWS})
    back = sorted(((r.page_id, r.url, bytes(r.payload)) for r in warc.restored(spark, folder).collect()), key=str)
    assert back == sorted(((p, u or "", (h or "").encode()) for p, u, h in ROWS), key=str)
    for r in warc.records(spark, folder).collect():
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and block.endswith(b"\r\n\r\n")
        size = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert len(block) == size + 4


def test_damage_is_noticed(spark):
    folder = shared_folder(spark)
    warc.write(pages(spark, ROWS[:1]), folder)
    stored = spark.read.parquet(f"{folder}/payloads").collect()
    spark.createDataFrame([(stored[0].digest, bytearray(b"changed"), stored[0].n)], "digest string, payload binary, n long").write.mode("overwrite").parquet(f"{folder}/payloads")
    try:
        warc.payloads(spark, folder).collect()
    except Exception as error:
        assert "damaged" in str(error)
    else:
        raise AssertionError("no error")


def test_urls_with_line_breaks_and_a_shared_payload(spark, monkeypatch):
    from tessera.llm import tables

    monkeypatch.setattr(tables, "HEAVY_LEAST", 10)
    monkeypatch.setattr(tables, "HEAVY_SHARE", 20)
    odd = ["http://a/\r\nX: y", "http://b/%0A", "\n", "http://c/%0D%0A\r", None]
    rows = [(i, odd[i % 5], BIG if i % 3 else f"<p>{i}" + "z" * 1500) for i in range(150)] + [(150, "http://z/", "v" * 3_000_000)]
    folder = shared_folder(spark)
    warc.write(pages(spark, rows), folder)
    back = sorted(((r.page_id, r.url, bytes(r.payload)) for r in warc.restored(spark, folder).collect()), key=str)
    assert back == sorted(((p, u or "", h.encode()) for p, u, h in rows), key=str)
    assert sorted(map(tuple, warc.listing(spark, folder).collect()), key=str) == expected(rows)
