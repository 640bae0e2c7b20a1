"""What lies inside entries: layouts against a writer of its own, order of transactions, damage."""

import gzip

import pytest

from ledgerloom.sources import layouts, xdr

from . import archives as a

KEY = a.u32(0) + b"k" * 32
NATIVE = a.u32(0)
COIN = a.u32(1) + b"EUR\0" + KEY
SYMBOL = a.u32(15) + a.text(b"transfer")
CONTRACT = a.u32(1) + b"c" * 32
CALL = CONTRACT + a.text(b"transfer") + a.u32(2) + SYMBOL + a.u32(10) + b"\0" * 16
VALUES = [
    a.u32(0) + a.u32(1), a.u32(1), a.u32(2) + a.u32(0) + a.u32(7), a.u32(3) + a.u32(7), a.u32(5) + a.i64(7), a.u32(11) + b"u" * 32, a.u32(13) + a.text(b"byte!"),
    a.u32(16) + a.u32(1) + a.u32(2) + SYMBOL + a.u32(1), a.u32(17) + a.u32(1) + a.u32(1) + SYMBOL + a.u32(16) + a.u32(0), a.u32(18) + CONTRACT,
    a.u32(19) + a.u32(1) + a.u32(0), a.u32(20), a.u32(21) + a.i64(1),
]
PREDICATE = a.u32(1) + a.u32(2) + a.u32(4) + a.i64(1) + a.u32(3) + a.u32(1) + a.u32(0)
OPERATIONS = [
    KEY + a.i64(1), KEY + COIN + a.i64(1), COIN + a.i64(1) + KEY + NATIVE + a.i64(1) + a.u32(2) + COIN + NATIVE, COIN + NATIVE + a.i64(1) + a.u32(1) * 2 + a.i64(0),
    COIN + NATIVE + a.i64(1) + a.u32(1) * 2, a.u32(1) + KEY + a.u32(0) * 5 + a.u32(1) + a.u32(3) + a.u32(1) + a.text(b"home.org") + a.u32(1) + a.u32(3) + b"x" * 32 + a.text(b"pay") + a.u32(1),
    a.u32(3) + a.u32(0) + NATIVE + COIN + a.u32(30) + a.i64(1), KEY + a.u32(2) + b"TWELVE\0\0\0\0\0\0" + a.u32(1), KEY, b"", a.text(b"name") + a.u32(1) + a.text(b"data!"), a.i64(9),
    COIN + NATIVE + a.i64(1) + a.u32(1) * 2 + a.i64(0), COIN + a.i64(1) + KEY + NATIVE + a.i64(1) + a.u32(0), COIN + a.i64(1) + a.u32(1) + a.u32(0) + KEY + PREDICATE, a.u32(0) + b"b" * 32,
    KEY, b"", a.u32(0) + a.u32(6) + CONTRACT + SYMBOL + a.u32(1), COIN + KEY + a.i64(1), a.u32(0) + b"b" * 32, KEY + COIN + a.u32(1) * 2, b"p" * 32 + a.i64(1) * 2 + a.u32(1) * 4,
    b"p" * 32 + a.i64(1) * 3, a.u32(0) + CALL + a.u32(1) + a.u32(1) + CONTRACT + a.i64(1) + a.u32(9) + SYMBOL + a.u32(0) + CALL + a.u32(1) + a.u32(0) + CALL + a.u32(0),
    a.u32(0) + a.u32(9), a.u32(0),
]


def operation(tag):
    return a.u32(0) + a.u32(tag) + OPERATIONS[tag]


def read(layout, data):
    layouts.whole(layout, data)
    for cut in range(len(data)):  # no shorter value passes
        with pytest.raises(layouts.Malformed):
            layouts.whole(layout, data[:cut])
    with pytest.raises(layouts.Malformed):
        layouts.whole(layout, data + b"\0\0\0\0")


@pytest.mark.parametrize("tag", range(len(OPERATIONS)))
def test_operations(tag):
    read(layouts.operation, operation(tag))


@pytest.mark.parametrize("value", VALUES)
def test_values(value):
    read(layouts.value, value)


def test_transactions():
    first, second = a.first_form(1, [a.payment(1)]), a.second_form(1, [a.payment(1)])
    conditions = a.u32(2) + a.u32(1) + a.i64(0) * 2 + a.u32(1) + a.u32(1) * 2 + a.u32(1) + a.i64(4) + a.i64(1) + a.u32(0) + a.u32(1) + a.u32(1) + b"t" * 32
    resources = a.u32(1) + a.u32(2) + a.u32(3) + a.u32(4) + a.u32(1) + a.u32(7) + b"w" * 32 + a.u32(1) + a.u32(0) + KEY + a.u32(5) * 3 + a.i64(1)
    contract = a.u32(2) + KEY + a.u32(1) + a.i64(1) + conditions + a.u32(2) + a.i64(3) + a.u32(1) + operation(24) + a.u32(1) + resources + a.u32(0)
    bump = a.u32(5) + KEY + a.i64(9) + second + a.u32(0) + a.u32(1) + b"hint" + a.text(b"s")
    for one in (first, second, contract, bump):
        read(layouts.transaction, one)
    read(layouts.general_set, a.u32(1) + b"p" * 32 + a.u32(2) + a.u32(0) + a.u32(1) + a.u32(0) + a.u32(0) + a.u32(1) + second + a.u32(1) + a.u32(1) + a.i64(5) + a.u32(1) + a.u32(1) + a.u32(1) + contract)


def test_results():
    trades = a.u32(3) + a.u32(0) + b"s" * 32 + a.i64(1) + (NATIVE + a.i64(1)) * 2 + a.u32(1) + KEY + a.i64(1) + (COIN + a.i64(1)) * 2 + a.u32(2) + b"p" * 32 + (COIN + a.i64(1)) * 2
    offer = KEY + a.i64(1) + COIN + NATIVE + a.i64(1) + a.u32(1) * 2 + a.u32(0) * 2
    good = {2: trades + KEY + COIN + a.i64(1), 3: trades + a.u32(0) + offer, 12: a.u32(0) + a.u32(2), 8: a.i64(1), 9: a.u32(1) + KEY + a.i64(1), 14: a.u32(0) + b"b" * 32, 24: b"h" * 32}
    for tag in range(len(OPERATIONS)):
        read(layouts.operation_result, a.u32(0) + a.u32(tag) + a.u32(0) + good.get(tag, good[3] if tag == 4 else good[2] if tag == 13 else b""))
        read(layouts.operation_result, a.u32(0) + a.u32(tag) + a.i32(-3))
    read(layouts.operation_result, a.u32(0) + a.u32(13) + a.i32(-9) + COIN)
    read(layouts.operation_result, a.i32(-1))
    inner = b"i" * 32 + a.i64(1) + a.u32(0) + a.u32(1) + a.i32(-2) + a.u32(0)
    for code, held in ((1, inner), (-13, inner), (0, a.u32(0)), (-1, a.u32(0)), (-5, b""), (-40, b"")):
        read(layouts.result, b"h" * 32 + a.i64(1) + a.i32(code) + held + a.u32(0))
    with pytest.raises(layouts.Malformed):
        layouts.whole(layouts.result, b"h" * 32 + a.i64(1) + a.i32(2) + a.u32(0))


def test_consensus():
    ballot = a.u32(1) + a.text(b"value")
    for statement in (a.u32(0) + b"q" * 32 + ballot + a.u32(1) + ballot + a.u32(0) + a.u32(1) * 2, a.u32(1) + ballot + a.u32(1) * 3 + b"q" * 32, a.u32(2) + ballot + a.u32(1) + b"q" * 32, a.u32(3) + b"q" * 32 + a.u32(1) + a.text(b"v") + a.u32(0)):
        inner = a.u32(1) + a.u32(1) + KEY + a.u32(0)
        read(layouts.CONSENSUS, a.u32(0) + a.u32(1) + a.u32(2) + a.u32(1) + KEY + a.u32(1) + inner + a.u32(100) + a.u32(1) + KEY + a.i64(1) + statement + a.text(b"sig"))
    read(layouts.CONSENSUS, a.u32(0) + a.u32(0) + a.u32(100) + a.u32(0))


def test_order_of_transactions():
    bodies = sorted((a.first_form(k) for k in range(5)), key=a.sha)
    prev = b"p" * 32
    entry = lambda found: a.u32(100) + prev + a.u32(len(found)) + b"".join(found) + a.u32(0)
    assert xdr.decode("transactions", 127, a.framed(entry(bodies)))[0]["hash"] == a.sha(prev, *bodies).hex()
    assert xdr.decode("transactions", 127, a.framed(entry(bodies[:1] * 2)))[0]["seq"] == 100  # equal hashes are in order
    assert xdr.decode("transactions", 127, a.framed(entry([])))[0]["hash"] == a.sha(prev).hex()
    with pytest.raises(xdr.Broken, match="out of order"):
        xdr.decode("transactions", 127, a.framed(entry(bodies[::-1])))
    with pytest.raises(xdr.Broken, match="transactions entry"):
        xdr.decode("transactions", 127, a.framed(entry([b"not a transaction"])))


def test_broken_values():
    deep = b"".join([a.u32(16) + a.u32(1) + a.u32(1)] * 5000) + a.u32(1)
    for layout, data in ((layouts.value, deep), (layouts.value, a.u32(99)), (layouts.value, a.u32(0) + a.u32(2)), (layouts.value, a.u32(13) + a.u32(1) + b"xx\0\0"), (layouts.value, a.u32(16) + a.u32(1) + b"\xff" * 4), (layouts.memo, a.u32(1) + a.text(b"m" * 29)), (layouts.maybe(layouts.word), a.u32(2) + a.u32(0))):
        with pytest.raises(layouts.Malformed):
            layouts.whole(layout, data)
    for kind in ("results", "scp"):
        with pytest.raises(xdr.Broken):
            xdr.decode(kind, 127, a.framed(b"not an entry"))


def test_files_in_pieces(monkeypatch):
    """Records across pieces; damage of the file goes before what is wrong inside it."""
    monkeypatch.setattr(xdr, "STEP", 7)
    entries = [a.results(seq)[0] for seq in range(64, 128)]
    assert [r["seq"] for r in xdr.decode("results", 127, a.framed(*entries))] == list(range(64, 128))
    assert xdr.decode("results", 127, gzip.compress(b"")) == []
    damaged = bytearray(a.framed(b"not an entry", *entries))
    damaged[-8] ^= 1  # the checksum
    with pytest.raises(xdr.Broken) as found:
        xdr.decode("results", 127, bytes(damaged))
    assert found.value.retry
    with pytest.raises(xdr.Broken) as found:
        xdr.decode("results", 127, a.framed(b"not an entry", *entries))
    assert not found.value.retry


def test_general_sets():
    prev = b"p" * 32
    entry, expected = a.transactions(100, prev, True)
    assert xdr.transaction_entry(entry) == (100, {"hash": expected.hex()})
    for cut in range(len(entry)):
        with pytest.raises((xdr.Broken, layouts.Malformed)):
            xdr.transaction_entry(entry[:cut])
    with pytest.raises(layouts.Malformed):
        xdr.transaction_entry(entry + a.u32(0))
