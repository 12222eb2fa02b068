import glob
import gzip
import random

from notegraph.llm.warc import RECORDS_PER_ARCHIVE, archive_pages, parse, payload_digest, plan_records, read_archives, record, salvage, write_archives

SCHEMA = "page_id bigint, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


ROWS = [
    (1, "http://a", "same"), (2, None, "same"), (9, "http://c d\n", "same"), (3, "u", None), (4, "u", ""), (5, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"),
    (6, "u", "é" * 50_000), (7, "u", "\x1f\x8b\x08 not a member"), (None, "u", "same"), (8, "u", "once"), (8, "u", "once"),
]


def test_round_trip(spark):
    found = archive_pages(pages(spark, ROWS)).collect()
    assert all(r["reason"] is None for r in found) and len(found) == len(ROWS)
    by_id = {}
    for r in found:
        by_id.setdefault(r["record_id"], []).append(r)
    for page_id, _, html in ROWS:
        payload = (html or "").encode()
        for r in by_id[f"<urn:page:{page_id}>"]:
            assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), payload_digest(payload))
            assert (r["payload"] is None) == (r["record_type"] == "revisit")
            assert r["payload"] is None or bytes(r["payload"]) == payload
    kinds = {k: (v[0]["record_type"], v[0]["refers_to"]) for k, v in by_id.items()}
    assert kinds["<urn:page:1>"] == kinds["<urn:page:2>"] == kinds["<urn:page:None>"] == ("revisit", "<urn:page:9>")
    assert kinds["<urn:page:9>"] == ("response", None) and kinds["<urn:page:3>"] == ("revisit", "<urn:page:4>")
    assert [r["record_type"] for r in by_id["<urn:page:8>"]] == ["response", "response"]


def test_small_payloads_are_responses(spark):
    kinds = {r["page_id"]: r["record_type"] for r in plan_records(pages(spark, [(1, "", "ab"), (2, "", "ab"), (3, "", "abc"), (4, "", "abc")]), min_bytes=3).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_empty_table(spark):
    assert archive_pages(pages(spark, [])).count() == 0


def test_any_gzip_reader_reads_the_archives(spark, tmp_path):
    folder = str(tmp_path / "archives")
    write_archives(plan_records(pages(spark, [(k, "u", f"page {k}") for k in range(30)])).coalesce(1), folder, most=10)
    files = glob.glob(folder + "/part-*")
    assert len(files) == 3 < RECORDS_PER_ARCHIVE
    data = b"".join(gzip.open(f).read() for f in files)
    assert data.count(b"WARC-Type: response") == 30
    # A damaged archive: later records are recovered and the gap is reported.
    raw = bytearray(open(files[0], "rb").read())
    raw[len(raw) // 2] ^= 0xFF
    damaged = tmp_path / "damaged"
    damaged.mkdir()
    for k, data in enumerate([bytes(raw), *(open(f, "rb").read() for f in files[1:])]):
        (damaged / f"{k}.warc.gz").write_bytes(data)
    found = read_archives(spark, str(damaged)).collect()
    good = [r for r in found if r["reason"] is None]
    gaps = [r for r in found if r["reason"] is not None]
    assert len(good) == 29 and len(gaps) == 1 and gaps[0]["payload_bytes"] is None


def test_salvage_of_plain_and_mixed_damage():
    one = [record(k, "u", b"payload %d " % k * 40, "response", None, "2024-01-01T00:00:00Z") for k in range(6)]
    plain = b"".join(one)
    assert [x.headers["warc-record-id"] for x in salvage(plain)] == [f"<urn:page:{k}>" for k in range(6)]
    # Junk in front, a cut record, a flipped payload byte, a truncated end.
    broken = b"junk" + one[0] + one[1][:-60] + one[2] + one[3].replace(b"payload 3", b"pAyload 3", 1) + gzip.compress(one[4]) + one[5][:-5]
    found = list(salvage(broken))
    assert [x.headers["warc-record-id"] for x in found if x.reason is None] == ["<urn:page:0>", "<urn:page:2>", "<urn:page:4>"]
    assert [x.reason is not None for x in found] == [True, False, True, False, True, False, True]
    assert sum(x.length for x in found) == len(broken)
    assert list(salvage(b"")) == [] and [x.length for x in salvage(b"only junk")] == [9]
    end, headers, payload = parse(one[0], 0)
    assert end == len(one[0]) and headers["warc-type"] == "response" and payload == b"payload 0 " * 40


def test_salvage_inside_damaged_members():
    one = [record(k, "u", b"payload %d " % k * 40, "response", None, "2024-01-01T00:00:00Z") for k in range(5)]
    names = lambda found: [x.headers["warc-record-id"][10:-1] for x in found if x.reason is None]
    wrong = [*one[:2], one[2].replace(b"payload 2", b"pAyload 2", 1), *one[3:]]
    member = gzip.compress(b"".join(wrong))
    found = list(salvage(member + gzip.compress(one[2])))
    assert names(found) == ["0", "1", "3", "4", "2"]
    assert [(x.offset, x.length, x.inside, x.size) for x in found if x.reason] == [(0, len(member), len(one[0]) * 2, len(one[2]))]
    # A member that breaks off, a wrong check sum, and damage in the middle of one; later members are found.
    r = random.Random(4)
    noisy = [record(k, "u", bytes(r.randrange(256) for _ in range(900)), "response", None, "2024-01-01T00:00:00Z") for k in range(5)]
    member, behind = gzip.compress(b"".join(noisy)), gzip.compress(one[0])
    cut = list(salvage(member[:-200]))
    assert names(cut) == ["0", "1", "2", "3"] and cut[-1].reason == "member without end" and cut[-1].size > 0
    for at in (len(member) - 6, len(member) // 2):
        damaged = bytearray(member)
        damaged[at] ^= 0xFF
        found = list(salvage(bytes(damaged) + behind))
        assert names(found)[:2] == ["0", "1"] and names(found)[-1] == "0" and any(x.reason for x in found)
        assert len(names(found)) >= 3
    # The bytes of members and of the gaps outside them make up the archive, whatever is damaged.
    for _ in range(200):
        damaged = bytearray(member[:1500] + behind + member + b"junk" + behind + one[1])
        for _ in range(r.randint(1, 4)):
            damaged[r.randrange(len(damaged))] ^= 1 << r.randrange(8)
        found = list(salvage(bytes(damaged)))
        spans = sorted({(x.offset, x.length) for x in found})
        assert sum(n for _, n in spans) == len(damaged) and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
