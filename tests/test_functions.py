import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import checkpoints as c
from ledgerloom.functions.states import STATE, bucket_hashes, state_error
from ledgerloom.operators import bounds
from ledgerloom.sources import history

from .archives import state


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("ledger,low,high", [(0, 63, 63), (1, 63, 63), (62, 63, 63), (63, 63, 63), (64, 63, 127), (100, 63, 127), (126, 63, 127), (128, 127, 191), (192, 191, 255)])
def test_rounding(spark, ledger, low, high):
    x = F.lit(ledger).cast("bigint")
    assert tuple(one(spark, c.floor_checkpoint(x), c.ceil_checkpoint(x))) == (low, high)
    assert (bounds.floor_checkpoint(ledger), bounds.ceil_checkpoint(ledger)) == (low, high)


@pytest.mark.parametrize("low,high,n", [(63, 63, 1), (63, 255, 4), (127, 63, 0), (63, 639, 10)])
def test_count(spark, low, high, n):
    assert one(spark, c.count_checkpoints(F.lit(low), F.lit(high)))[0] == n


def test_count_of_no_checkpoint_fails(spark):
    with pytest.raises(Exception, match="not a checkpoint"):
        one(spark, c.count_checkpoints(F.lit(64), F.lit(127)))


def test_paths(spark):
    cp = F.lit(0x01020304).cast("bigint")
    assert one(spark, c.checkpoint_prefix(cp))[0] == "01/02/03"
    path = one(spark, c.checkpoint_path(F.lit("ledger"), F.lit(63)))[0]
    assert path == "ledger/00/00/00/ledger-0000003f.xdr.gz"
    p = F.lit(path)
    assert tuple(one(spark, c.checkpoint_from_path(p), c.kind_of_path(p), c.flag_of_kind(c.kind_of_path(p)))) == (63, "ledger", 2)
    h = F.lit("Ab" * 32)
    b = c.bucket_path(h)
    assert tuple(one(spark, c.hash_from_path(b), c.kind_of_path(b))) == ("ab" * 32, "bucket")
    assert one(spark, c.hash_prefix(F.lit("abc")))[0] is None


@pytest.mark.parametrize("h,valid", [("a" * 63, False), ("a" * 65, False), ("g" + "a" * 63, False), (" " + "a" * 63, False), ("aB" * 32, True), ("a" * 64 + "\n", False), (None, None)])
def test_hash(spark, h, valid):
    assert one(spark, c.is_valid_hash(F.lit(h).cast("string")))[0] is valid


def states(spark, d):
    return spark.createDataFrame([(history.parse(__import__("json").dumps(d)),)], "s " + STATE.simpleString())


def error(spark, d):
    return states(spark, d).select(state_error(F.col("s"))).first()[0]


H = "ab" * 32


@pytest.mark.parametrize("nxt,ok", [
    ({"state": 0}, True), ({"state": 0, "output": H}, False), ({"state": 0, "shadow": []}, False), ({"state": 1}, False), ({"state": 1, "output": H}, True), ({"state": 1, "output": "x"}, False),
    ({"state": 1, "output": H, "curr": H}, False), ({"state": 2, "curr": H, "snap": H}, True), ({"state": 2, "curr": H}, False), ({"state": 2, "curr": H, "snap": H, "shadow": ["x"]}, False),
    ({"state": 2, "curr": H, "snap": H, "output": H}, True), ({"state": 3}, False),
])
def test_next_state(spark, nxt, ok):
    d = state(63, [H])
    d["currentBuckets"][3] = {"curr": H, "snap": H, "next": nxt}
    assert (error(spark, d) is None) == ok


@pytest.mark.parametrize("change,part", [({"version": 3}, "version"), ({"version": 2}, "hot"), ({"currentLedger": 64}, "checkpoint"), ({"currentLedger": 0}, "checkpoint")])
def test_state_rules(spark, change, part):
    assert part in error(spark, state(63, [H]) | change)
    assert error(spark, state(63, [H], 2)) is None


def test_bucket_hashes(spark):
    d = state(63, [H, "CD" * 32, H])
    d["currentBuckets"][0] = {"curr": H, "snap": H, "next": {"state": 1, "output": "ef" * 32}}
    assert states(spark, d).select(bucket_hashes(F.col("s"))).first()[0] == ["CD" * 32, H, "ef" * 32]


@pytest.mark.parametrize("text", ["", "[]", '{"version": 1} x', '{"version": 1, "version": 1}', '{"version": NaN}', '{"version": "1"}', '{"version": 1.0}', b"\xff"])
def test_malformed(text):
    with pytest.raises(history.Malformed):
        history.parse(text)


def test_levels_are_eleven():
    d = state(63, [H])
    d["currentBuckets"].pop()
    with pytest.raises(history.Malformed):
        history.parse(__import__("json").dumps(d))


L, D = 6399, None


@pytest.mark.parametrize("args,expected", [
    ((L, 6399), "done"), ((L, 127), (191, L)), ((L, 127, 64), (191, L)), ((L, 127, 500), "gap"), ((L, 127, 500, None, False, True), (447, L)), ((L, 127, 100, None, True), (63, L)),
    ((L, None, 500), (447, L)), ((L, None), (63, L)), ((L, 127, None, None, True), (63, L)), ((L, 127, 500, None, True), "gap"), ((L, None, None, 1000), (63, 1023)),
])
def test_mirror_bounds(args, expected):
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        if expected == "gap":
            with pytest.raises(bounds.GapDetected):
                bounds.mirror_bounds(*args)
        else:
            b = bounds.mirror_bounds(*args)
            assert "done" if b.empty else (b.low, b.high) == expected


def test_archive_bounds():
    with pytest.raises(bounds.BoundsError):
        bounds.archive_bounds(127, 500)
    with pytest.raises(bounds.BoundsError):
        bounds.archive_bounds(639, 500, 100)
    with pytest.warns(UserWarning):
        assert bounds.archive_bounds(127, None, 10_000) == bounds.Bounds(63, 127)
