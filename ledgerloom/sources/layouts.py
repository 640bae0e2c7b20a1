"""Layouts of what lies inside transaction, result and consensus entries.

A layout is a function from (bytes, position) to the position after the value;
it raises ``Malformed`` where the bytes break the layout. Only extents are
found: nothing is built from the values, so an entry costs no memory of its own.
Layouts that contain themselves are looked up by name when they are met.

Result codes below zero hold nothing unless the layout says otherwise, known or
not, so that codes of later protocols pass.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

Layout = Callable[[bytes, int], int]

_INT = struct.Struct(">i").unpack_from
_COUNT = struct.Struct(">I").unpack_from


class Malformed(Exception):
    pass


def fixed(n: int) -> Layout:
    return lambda data, at: at + n


def opaque(most: int = 0xFFFFFFFF) -> Layout:
    """Counted bytes, padded with zeros to a multiple of four."""

    def read(data, at):
        (n,) = _COUNT(data, at)
        if n > most:
            raise Malformed("opaque value is too long")
        stop = at + 4 + n + -n % 4
        if stop > len(data):
            raise Malformed("entry ends early")
        if any(data[at + 4 + n : stop]):
            raise Malformed("padding is not zero")
        return stop

    return read


def many(item: Layout, most: int = 0xFFFFFFFF) -> Layout:
    def read(data, at):
        (n,) = _COUNT(data, at)
        at += 4
        if n > most or 4 * n > len(data) - at:  # no item is shorter than four bytes
            raise Malformed("array is too long")
        for _ in range(n):
            at = item(data, at)
        return at

    return read


def row(*fields: Layout) -> Layout:
    def read(data, at):
        for field in fields:
            at = field(data, at)
        return at

    return read


def either(cases: dict[int, Layout], failures: bool = False) -> Layout:
    """A tagged value; with ``failures`` every other tag below zero stands for itself."""

    def read(data, at):
        (tag,) = _INT(data, at)
        case = cases.get(tag)
        if case is not None:
            return case(data, at + 4)
        if failures and tag < 0:
            return at + 4
        raise Malformed(f"unknown tag {tag}")

    return read


def named(name: str) -> Layout:
    return lambda data, at: globals()[name](data, at)


nothing, word, long, digest = fixed(0), fixed(4), fixed(8), fixed(32)
no_extension = either({0: nothing})
flag = either({0: nothing, 1: nothing})


def maybe(item: Layout) -> Layout:
    return either({0: nothing, 1: item})


# accounts, assets, keys
account = either({0: digest})
muxed = either({0: digest, 256: fixed(40)})
signer_key = either({0: digest, 1: digest, 2: digest, 3: row(digest, opaque(64))})
_asset_cases = {0: nothing, 1: row(fixed(4), account), 2: row(fixed(12), account)}
asset = either(_asset_cases)
balance_id = either({0: digest})
price = fixed(8)
pool_parameters = either({0: row(asset, asset, word)})

# contract values
address = either({0: account, 1: digest, 2: fixed(40), 3: balance_id, 4: digest})
executable = either({0: digest, 1: nothing})
symbol = opaque(32)
_value = named("value")
value_map = many(row(_value, _value))
value = either({
    0: flag, 1: nothing, 2: either({kind: word for kind in range(10)}), 3: word, 4: word, 5: long, 6: long, 7: long, 8: long,
    9: fixed(16), 10: fixed(16), 11: digest, 12: digest, 13: opaque(), 14: opaque(), 15: symbol, 16: maybe(many(_value)), 17: maybe(value_map),
    18: address, 19: row(executable, maybe(value_map)), 20: nothing, 21: long,
})
ledger_key = either({
    0: account, 1: row(account, either(_asset_cases | {3: digest})), 2: row(account, long), 3: row(account, opaque(64)), 4: balance_id, 5: digest,
    6: row(address, value, flag), 7: digest, 8: word, 9: digest,
})
contract_call = row(address, symbol, many(value))
contract_source = either({0: row(address, digest), 1: asset})
contract_creation = row(contract_source, executable)
contract_creation_2 = row(contract_source, executable, many(value))
host_function = either({0: contract_call, 1: contract_creation, 2: opaque(), 3: contract_creation_2})
invocation = row(either({0: contract_call, 1: contract_creation, 2: contract_creation_2}), many(named("invocation")))
authorization = row(either({0: nothing, 1: row(address, long, word, value)}), invocation)
resources = row(either({0: nothing, 1: many(word)}), many(ledger_key), many(ledger_key), fixed(12), long)

# operations, in the order of their tags
_predicate = named("predicate")
predicate = either({0: nothing, 1: many(_predicate, 2), 2: many(_predicate, 2), 3: maybe(_predicate), 4: long, 5: long})
_path_payment = row(asset, long, muxed, asset, long, many(asset, 5))
_offer = row(asset, asset, long, price, long)
_options = row(maybe(account), *[maybe(word)] * 6, maybe(opaque(32)), maybe(row(signer_key, word)))
OPERATIONS = (
    row(account, long), row(muxed, asset, long), _path_payment, _offer, row(asset, asset, long, price), _options,
    row(either(_asset_cases | {3: pool_parameters}), long), row(account, either({1: fixed(4), 2: fixed(12)}), word), muxed, nothing,
    row(opaque(64), maybe(opaque(64))), long, _offer, _path_payment, row(asset, long, many(either({0: row(account, predicate)}), 10)), balance_id,
    account, nothing, either({0: ledger_key, 1: row(account, signer_key)}), row(asset, muxed, long), balance_id,
    row(account, asset, fixed(8)), row(digest, fixed(16), price, price), row(digest, fixed(24)),
    row(host_function, many(authorization)), row(no_extension, word), no_extension,
)
operation = row(maybe(muxed), either(dict(enumerate(OPERATIONS))))

# transactions and their sets
memo = either({0: nothing, 1: opaque(28), 2: long, 3: digest, 4: digest})
time_bounds = fixed(16)
conditions = either({0: nothing, 1: time_bounds, 2: row(maybe(time_bounds), maybe(fixed(8)), maybe(long), long, word, many(signer_key, 2))})
signatures = many(row(fixed(4), opaque(64)), 20)
_first_form = row(digest, word, long, maybe(time_bounds), memo, many(operation, 100), no_extension, signatures)
_second_form = row(muxed, word, long, conditions, memo, many(operation, 100), either({0: nothing, 1: resources}), signatures)
transaction = either({0: _first_form, 2: _second_form, 5: row(muxed, long, either({2: _second_form}), no_extension, signatures)})
_component = either({0: row(maybe(long), many(transaction))})
_parallel = row(maybe(long), many(many(many(transaction))))
general_set = either({1: row(digest, many(either({0: many(_component), 1: _parallel})))})

# results, in the order of the operations' tags
_trade = either({0: row(digest, long, asset, long, asset, long), 1: row(account, long, asset, long, asset, long), 2: row(digest, asset, long, asset, long)})
_offer_entry = row(account, long, asset, asset, long, price, word, no_extension)


def _outcome(success: Layout = nothing, **other: Layout) -> Layout:
    return either({0: success, **{-int(code[1:]): layout for code, layout in other.items()}}, failures=True)


_paid = _outcome(row(many(_trade), account, asset, long), _9=asset)
_offered = _outcome(row(many(_trade), either({0: _offer_entry, 1: _offer_entry, 2: nothing})))
_SUCCESS = {2: _paid, 3: _offered, 4: _offered, 8: _outcome(long), 9: _outcome(many(row(account, long))), 12: _offered, 13: _paid, 14: _outcome(balance_id), 24: _outcome(digest)}
operation_result = _outcome(either({tag: _SUCCESS.get(tag, _outcome()) for tag in range(len(OPERATIONS))}))
_results = many(operation_result)
_inner = row(digest, long, either({0: _results, -1: _results}, failures=True), no_extension)
result = row(digest, long, either({1: _inner, 0: _results, -1: _results, -13: _inner}, failures=True), no_extension)

# consensus
_quorum = row(word, many(account), many(named("_quorum")))
_ballot = row(word, opaque())
_statement = either({
    0: row(digest, _ballot, maybe(_ballot), maybe(_ballot), fixed(8)),
    1: row(_ballot, fixed(12), digest),
    2: row(_ballot, word, digest),
    3: row(digest, many(opaque()), many(opaque())),
})

GENERAL = either({0: nothing, 1: general_set})
RESULTS = row(word, many(result), no_extension)
CONSENSUS = either({0: row(many(_quorum), word, many(row(account, long, _statement, opaque(64))))})


def end(layout: Layout, data: bytes, at: int = 0) -> int:
    """Position after the value at ``at``."""
    try:
        stop = layout(data, at)
    except struct.error as e:
        raise Malformed("entry ends early") from e
    except RecursionError as e:
        raise Malformed("entry is nested too deeply") from e
    if stop > len(data):
        raise Malformed("entry ends early")
    return stop


def whole(layout: Layout, data: bytes, at: int = 0) -> None:
    """The value at ``at`` is the last one."""
    if end(layout, data, at) != len(data):
        raise Malformed("bytes after the entry")


def items(layout: Layout, n: int, data: bytes, at: int) -> Iterator[tuple[int, int]]:
    """Extents of ``n`` values from ``at`` on."""
    for _ in range(n):
        start, at = at, end(layout, data, at)
        yield start, at
