"""Operator 11: archives written and read again, over many splits and with magics anywhere."""

import base64
import collections
import hashlib
import random

import pytest

from sharetide.llm.op11_warc import MAGIC, page_records, read_archives, write_archives
from sharetide.session import fresh_path

SCHEMA = "page_id bigint, url string, html string"
INNER = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77:x>\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nContent-Length: {n}\r\n\r\n"


def expected(rows):
    """Sorted (page_id, bytes, digest, type, refers_to); rows that tie in key and payload are alike."""
    groups, out = collections.defaultdict(list), []
    for key, _, html in rows:
        groups[html or ""].append(key)
    for html, keys in groups.items():
        data, lead = html.encode(), max((k for k in keys if k is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        rest = list(keys)
        rest.remove(lead)
        out.append((lead, len(data), digest, "response", None))
        out += [(k, len(data), digest, "revisit", lead) for k in rest]
    return sorted(out, key=str)


def both_ways(spark, rows, **kind):
    path = fresh_path(spark, "warc")
    write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), path, **kind)
    return path, page_records(read_archives(spark, path, payloads=True))


def told(found):
    return sorted(((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_key) for r in found.collect()), key=str)


@pytest.fixture
def small_splits(llm):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {k: llm.conf.get(k) for k in keys}
    for k, v in keys.items():
        llm.conf.set(k, v)
    yield llm
    for k, v in before.items():
        llm.conf.set(k, v)


def planted():
    r = random.Random(3)
    bits = ["WARC/1.1\r\n", "\r\n", "\r\n\r\n", "WARC/1.1", "W", "x" * 50, "é漢😀", INNER.format(n=4) + "abcd\r\n\r\n", INNER.format(n=9000), INNER.format(n=0), "Content-Length: 5\r\n\r\n"]
    rows = [(i, f"http://a/{i}", "".join(r.choice(bits) for _ in range(r.randrange(0, 40)))) for i in range(120)]
    rows += [(1000 + i, None, None if i % 2 else "") for i in range(5)]
    rows += [(2000 + i, "http://b/WARC/1.1", "copy " * 100) for i in range(60)]
    rows += [(3000, "a\r\nContent-Length: 3\r\n\r\nWARC/1.1\r\n", "y"), (None, "u", "no key"), (None, "u", "no key twice"), (5, "v", "no key twice"), (None, "w", "no key twice")]
    rows += [(7000, "z", "tie"), (7000, "z", "tie"), (7000, "z", "tie"), (8000, "long", "word " * 60000 + "WARC/1.1\r\n" * 50)]
    return rows


def test_records_come_back_over_many_splits(small_splits):
    rows = planted()
    _, found = both_ways(small_splits, rows)
    assert told(found) == expected(rows)
    texts = collections.Counter(r.payload.decode() for r in found.where("record_type = 'response'").collect())
    assert texts == collections.Counter({h or "": 1 for _, _, h in rows})


def test_small_payloads_are_all_responses_and_the_default_splits_agree(llm):
    rows = planted()
    assert told(both_ways(llm, rows)[1]) == expected(rows)
    few = [(1, "u", "a"), (2, "u", "a"), (3, "u", "abc"), (4, "u", "abc")]
    found = {r.key: (r.record_type, r.refers_to_key) for r in both_ways(llm, few, min_bytes=2)[1].collect()}
    assert found == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def test_other_columns_and_an_empty_table(llm):
    path = fresh_path(llm, "warc")
    rows = llm.createDataFrame([(1, "u", "a", "x", 3)], f"{SCHEMA}, payload string, digest int")
    write_archives(rows, path)
    assert read_archives(llm, path).select("payload_bytes", "url").collect() == [(1, "u")]
    path = fresh_path(llm, "warc")
    write_archives(llm.createDataFrame([], SCHEMA), path)
    assert read_archives(llm, path).count() == 0


def test_broken_files_are_refused(llm, tmp_path):
    good = MAGIC + INNER.format(n=2).encode()[len(MAGIC) :] + b"ab\r\n\r\n"
    for name, data in {"cut": good + good[:-7], "junk": b"junk" + good, "length": good.replace(b"Length: 2", b"Length: 9") + good}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(data)
        with pytest.raises(ValueError, match="end of the file"):
            read_archives(llm, str(tmp_path / name))
    assert read_archives(llm, str(tmp_path / "cut"), strict=False).count() == 1
    (tmp_path / "fine").mkdir()
    (tmp_path / "fine" / "a.warc").write_bytes(good * 3)
    assert read_archives(llm, str(tmp_path / "fine")).count() == 3
    wrong = good.replace(b"Content-Length", b"WARC-Payload-Digest: sha1:ABC\r\nContent-Length")
    (tmp_path / "wrong").mkdir()
    (tmp_path / "wrong" / "a.warc").write_bytes(wrong)
    with pytest.raises(Exception, match="does not match its digest"):
        read_archives(llm, str(tmp_path / "wrong")).count()
