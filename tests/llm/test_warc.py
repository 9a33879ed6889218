import gzip
import hashlib
import random
import time

import pytest

from seqrank.llm.warc import member, read_archives, record_bytes, salvage, write_archives

SCHEMA = "page_id long, url string, html string, id string, payload string, h string"


def record(k, payload=b"<p>some page</p>"):
    return record_bytes(k, f"http://a/{k}", payload, None, hashlib.sha256(payload).hexdigest())


def ids(raw):
    return [h["warc-record-id"] for kind, *_, h, _ in salvage(raw) if kind == "record"], [(s, e) for kind, s, e, *_ in salvage(raw) if kind == "gap"]


def urn(*keys):
    return [f"<urn:page:{k}>" for k in keys]


def test_members_end_with_a_zero_byte_and_are_gzip():
    for payload in (b"", b"x" * 300, bytes(range(256)) * 70_000):
        m = member(record(1, payload))
        assert m[-1] == 0 and gzip.decompress(m) == record(1, payload)


def test_plain_and_compressed_archives_read_whole():
    for pack in (lambda r: r, member):
        assert ids(b"".join(pack(record(k)) for k in range(5))) == (urn(0, 1, 2, 3, 4), [])
    assert ids(b"") == ([], [])


@pytest.mark.parametrize("pack", [lambda r: r, member], ids=["plain", "gzip"])
def test_damage_costs_the_record_that_it_hits(pack):
    parts = [pack(record(k, b"payload %d " % k * 40)) for k in range(5)]
    at = [sum(map(len, parts[:k])) for k in range(6)]
    whole = b"".join(parts)
    for k in range(5):
        middle = (at[k] + at[k + 1]) // 2
        bad = whole[:middle] + bytes([whole[middle] ^ 0x55]) + whole[middle + 1 :]
        found, gaps = ids(bad)
        assert found == urn(*(i for i in range(5) if i != k)) and gaps == [(at[k], at[k + 1])]


def test_junk_between_records_cut_ends_and_false_starts():
    a, b = member(record(1)), member(record(2))
    junk = b"\x1f\x8b\x08garbage WARC/1.1 not a line\r\n" * 3
    assert ids(a + junk + b) == (urn(1, 2), [(len(a), len(a) + len(junk))])
    assert ids(a + b[:-9]) == (urn(1, 2), [(len(a), len(a) + len(b) - 9)])  # cut behind its record
    assert ids(a + b[:60]) == (urn(1), [(len(a), len(a) + 60)])
    assert ids(junk) == ([], [(0, len(junk))])
    plain = record(3)
    assert ids(b"lead\n" + plain + b"tail") == (urn(3), [(0, 5), (5 + len(plain), 9 + len(plain))])


def test_records_of_a_damaged_member_of_several_are_recovered():
    parts = [record(k, b"payload %d " % k * 40) for k in range(10)]
    whole = b"".join(parts)
    bad = member(whole.replace(b"payload 4 payload 4", b"payload 4 qayload 4", 1))
    found = list(salvage(bad))
    at = whole.index(parts[4])
    assert [f.headers["warc-record-id"] for f in found if f.kind == "record"] == urn(*(k for k in range(10) if k != 4))
    assert [f[:5] for f in found if f.kind == "gap"] == [("gap", 0, len(bad), at, at + len(parts[4]))]
    packed = gzip.compress(whole, mtime=0)
    after = member(record(77))
    for cut in (packed[:-1], packed[:-8], packed[:-9]):  # its trailer, or the stream's end
        found, gaps = ids(cut)
        assert len(found) >= 9 and found == urn(*range(len(found))) and gaps == [(0, len(cut))]
        both = list(salvage(cut + after))  # what follows reads as the end of the checksum, which then fails
        assert [f.headers["warc-record-id"] for f in both if f.kind != "gap"] == urn(*range(len(found)), 77) and [f[:3] for f in both if f.kind == "gap"] == [("gap", 0, len(cut))]
    # a wrong checksum: what digests confirm is there, but suspect
    broken = packed[:-8] + bytes([packed[-8] ^ 1]) + packed[-7:]
    found = list(salvage(broken + after))
    assert [f.headers["warc-record-id"] for f in found if f.kind == "suspect"] == urn(*range(10))
    assert [f.headers["warc-record-id"] for f in found if f.kind == "record"] == urn(77)
    assert [f[:3] for f in found if f.kind == "gap"] == [("gap", 0, len(broken))]


def test_pieces_of_any_size_give_the_same():
    raw = b"junk\n" + b"".join(record(k) + b"\nWARC/1.1\r\nnothing\r\n" + member(record(10 + k) + record(20 + k)) for k in range(4)) + member(record(30))[:-30]
    for size in (1, 2, 7, 100, 4096):
        assert list(salvage(raw[k : k + size] for k in range(0, len(raw), size))) == list(salvage(raw))
    assert ids(raw)[0] == urn(*(i for k in range(4) for i in (k, 10 + k, 20 + k)))


def test_large_members_do_not_wait_whole(monkeypatch):
    monkeypatch.setattr("seqrank.llm.warc.HELD", 3_000)
    rng = random.Random(3)
    payloads = [rng.randbytes(900) for _ in range(40)]
    packed = gzip.compress(b"".join(record(k, x) for k, x in enumerate(payloads)), mtime=0)
    assert ids(packed) == (urn(*range(40)), [])
    found, gaps = ids(packed[:20_000] + b"?" * 500 + member(record(99)))
    assert found[-1] == urn(99)[0] and len(found) > 10 and found[:-1] == urn(*range(len(found) - 1)) and gaps == [(0, 20_500)]


def test_junk_version_lines_take_linear_time():
    junk = lambda n: b"WARC/1.1\r\nContent-Length: 900000000\r\n" * n + b"\nWARC/1.0\n" * n
    took = []
    for n in (5_000, 40_000):
        began = time.process_time()
        assert ids(junk(n) + record(1)) == (urn(1), [(0, len(junk(n)))])
        took.append(time.process_time() - began)
    assert took[1] < 8 * 4 * max(took[0], 0.02)


def test_digests_of_other_kinds_and_http_payloads():
    import base64

    body, head = b"<p>x</p>", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    sha1 = base64.b32encode(hashlib.sha1(body).digest())

    def made(digest):
        block = head + body
        return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (digest, len(block), block)

    assert ids(made(sha1)) == (urn(1), []) and ids(made(sha1[::-1]))[0] == []


def test_large_files_come_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("seqrank.llm.warc.WHOLE", 5_000)
    monkeypatch.setattr("seqrank.llm.warc.PIECE", 700)
    rng = random.Random(4)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        want = {}
        for k, end in enumerate((b"", b"\n", b"\n\n", b"x")):
            raw = b"".join(member(record(100 * k + i, rng.randbytes(rng.randrange(2_000)))) for i in range(90 if k else 3)) + end
            (tmp_path / f"a{k}.warc").write_bytes(raw)
            want |= {(f"a{k}.warc", f.kind, f.start, f.stop): f.sha256 for f in salvage(raw)}
        got = read_archives(spark, f"file://{tmp_path}", payloads=False).collect()
        assert {(r["path"].rsplit("/", 1)[1], r["kind"], r["start"], r["stop"]): r["payload_digest"] for r in got} == want and len(got) == len(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_wrong_digest_or_length_is_a_failed_check():
    good = record(1)
    assert ids(good.replace(b"some", b"same") + record(2))[0] == urn(2)
    assert ids(good.replace(b"Content-Length: 16", b"Content-Length: 15") + record(2))[0] == urn(2)
    assert ids(good.replace(b"Content-Length: 16", b"Content-Length: x") + record(2))[0] == urn(2)


def test_write_and_read_back(spark, tmp_path):
    big = "<b>" + "é" * 60
    pages = [(5, "http://a\nb", big), (3, None, big), (9, "u", big), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (3, None, big), (None, "u", big), (7, "u", "\0\r\n\r\nWARC/1.1\r\n" * 9), (8, "u", "x" * 300_000)]
    df = spark.createDataFrame([(*p, "x", "y", "z") for p in pages], SCHEMA)
    write_archives(df, str(tmp_path / "a"))
    rows = read_archives(spark, str(tmp_path / "a"))
    assert rows.filter("kind = 'gap'").isEmpty()
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows.collect()), key=str)
    want = []
    for i, _, html in pages:
        raw = (html or "").encode()
        revisit = html == big and i in (5, 9)
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert got == sorted(want, key=str)
    texts = {r["page_id"]: bytes(r["payload"]) for r in rows.filter("record_type = 'response' and page_id is not null").collect()}
    assert texts == {i: (h or "").encode() for i, _, h in pages if i in (1, 2, 3, 4, 6, 7, 8)}


def test_empty_table(spark, tmp_path):
    write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "a"))
    assert read_archives(spark, str(tmp_path / "a")).collect() == []


def test_header_lines_of_any_length_are_read(spark, tmp_path):
    same = "<p>" + "z" * 200
    pages = [(1, "http://a/" + "u" * 70_000, same), (2, "http://a/2", same), (3, "http://a/" + "v" * 2_000_000, "short"), (4, "http://a/4 " + "w " * 600_000, same), (5, "u", None)]
    write_archives(spark.createDataFrame([(*p, "x", "y", "z") for p in pages], SCHEMA), str(tmp_path / "a"))
    rows = {r["page_id"]: r for r in read_archives(spark, str(tmp_path / "a")).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5] and all(r["kind"] == "record" for r in rows.values())
    assert {i: r["refers_to"] for i, r in rows.items()} == {1: None, 2: 1, 3: None, 4: 1, 5: None}
    assert [rows[i]["url"] for i in (1, 2, 3)] == [u for _, u, _ in pages[:3]]
    assert all(r["refers_to"] is None or r["refers_to"] in rows for r in rows.values())


def test_version_lines_before_endless_lines_take_linear_time():
    junk = (b"WARC/1.1\r\nName: " + b"x" * 50_000 + b"\n") * 60 + b"WARC/1.1\r\nName: " + b"y" * 3_000_000
    began = time.perf_counter()
    got, gaps = ids(record(1) + junk + b"\n" + record(2))
    assert got == urn(1, 2) and len(gaps) == 1
    assert time.perf_counter() - began < 5
