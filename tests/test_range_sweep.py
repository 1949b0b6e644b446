"""The sweep over addresses and ranges: nesting across slices, large ids, and no row for each prefix length."""

import ipaddress
import random

import pytest

from hedgemark.operators import ranges as rng


def _tables(spark):
    drawn = random.Random(11)
    big = 1 << 60
    nets = [(big + n, f"10.{drawn.getrandbits(3)}.{drawn.getrandbits(3)}.0/{n % 33}") for n in range(120)]
    nets += [(big + 200 + n, f"2001:db8:{drawn.getrandbits(2):x}::/{n}") for n in range(0, 129, 3)]
    ips = [f"10.{drawn.getrandbits(3)}.{drawn.getrandbits(3)}.{drawn.getrandbits(4)}" for _ in range(400)]
    ips += [f"2001:db8:{drawn.getrandbits(2):x}::{drawn.getrandbits(4):x}" for _ in range(100)] + ["::1", "255.255.255.255", None]
    held = [(-net.prefixlen, i, net) for i, net in ((i, ipaddress.ip_network(t, strict=False)) for i, t in nets)]

    def best(text):
        ip = text and ipaddress.ip_address(text)
        return min(((p, i) for p, i, net in held if ip and net.version == ip.version and ip in net), default=(0, None))[1]

    rows = spark.createDataFrame(list(enumerate(ips)), "n int, ip string").repartition(4)
    return rows, spark.createDataFrame(nets, "range_id bigint, cidr string"), {n: best(t) for n, t in enumerate(ips)}


@pytest.mark.parametrize("slice_rows", [5, 60, 250_000])
def test_slices_do_not_change_the_result(spark, slice_rows):
    rows, ranges, wanted = _tables(spark)
    got = rng.narrowest_ranges(rows, ranges, "ip", ["n"], slice_rows=slice_rows).collect()
    assert len(got) == len(wanted)
    assert {r.n: r.range and r.range.range_id for r in got} == wanted


def test_an_address_is_one_row_whatever_the_prefix_lengths(spark, monkeypatch):
    rows, ranges, _ = _tables(spark)
    sizes, joined = [], rng.spread_join
    monkeypatch.setattr(rng, "spread_join", lambda left, *rest, **named: sizes.append(left.count()) or joined(left, *rest, **named))
    rng.narrowest_ranges(rows, ranges, "ip", ["n"])
    assert max(sizes) <= rows.count()
