"""The writer's rows: none is longer than a chunk and its frame, and together they are the record that its headers announce."""

import pytest

from inkscore.llm import warc


@pytest.mark.parametrize("size", [0, 1, 6, 7, 8, 700, 5000])
@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_rows_of_a_record(size, chunk):
    body = bytes(n % 251 for n in range(size))
    rows = list(warc.record_rows(5, "http://a b\n", "d", None, memoryview(body), chunk))
    assert max(len(r) for r in rows[1:]) <= chunk + 12
    whole = b"".join(r + b"\r\n" for r in rows)
    head, _, rest = whole.partition(b"\r\n\r\n")
    announced = int(head.split(b"Content-Length: ")[1])
    assert len(rest) == announced + 4 and rest.endswith(b"0\r\n\r\n\r\n\r\n"[-8:]) and b"http://a%20b%20" in head
    reader = warc._Reader(chunk)
    for line in whole.split(b"\n")[:-1]:
        reader.line(line)
    assert b"".join(r[4] for r in reader.rows) == body and reader.rows[-1][7] and reader.rows[-1][6] == size


def test_a_revisit_has_no_payload():
    rows = list(warc.record_rows(None, None, "d", 3, memoryview(b"x" * 500), 7))
    assert len(rows) == 2 and b"<urn:page:3>" in rows[0] and b"<urn:page:none>" in rows[0] and b"Content-Length: 500\r\n" in rows[0]
