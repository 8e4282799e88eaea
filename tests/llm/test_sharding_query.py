"""op9's query against a plain packer that scans its bins one by one."""

import hashlib
import zlib

import xxhash

from locus.llm import queries, sharding

SF = "/root/testdata/sf0.001"


def plain_pack(sizes, shards):
    """Best fit decreasing into the least capacity that does: big items alone, the others where the least room is left."""
    order, left, own = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)), sum(sizes), 0
    while own < shards - 1 and own < len(order) and sizes[order[own]] * (shards - own) > left:
        left, own = left - sizes[order[own]], own + 1
    least, slack = max([-(-left // (shards - own)), *(sizes[k] for k in order[own:]), 1]), 0.0
    while True:
        room, where = [], {}
        for k in order[own:]:
            fits = [(r, -b) for b, r in enumerate(room) if r >= sizes[k]]
            if fits:
                # Of bins with equal room the one that got it last.
                r = min(fits)[0]
                b = max((stamp[b], b) for b, x in enumerate(room) if x == r)[1]
            else:
                room.append(int(least * (1 + slack)))
                b = len(room) - 1
                stamp = {**(stamp if b else {}), b: 0}
            room[b] -= sizes[k]
            stamp[b] = max(stamp.values()) + 1
            where[k] = b
        if len(room) <= shards - own:
            return [place if place < own else own + where[k] for k, place in sorted((k, place) for place, k in enumerate(order))]
        slack = slack * 1.5 if slack else 1e-5


def test_query_against_plain_packing(spark):
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    sums = {}
    for _, text in rows:
        sums[text] = sums.get(text, 0) + len(text) + 1
    total = sum(sums.values())

    def item(text):
        digest = hashlib.sha256(text).digest()
        if sums[text] >= total / (sharding.LARGE * 8):
            return digest.hex().upper()
        return f"crate {_signed(xxhash.xxh64_intdigest(digest, seed=42)) % (sharding.CRATES * 8)}"

    items = {}
    for text, size in sums.items():
        items[item(text)] = items.get(item(text), 0) + size
    names = sorted(items)
    bins = dict(zip(names, plain_pack([items[n] for n in names], 8), strict=True))
    got = {r.doc_id: r for r in queries.op9_sharding(spark, SF).collect()}
    assert {k: (r.shard, r.size, r.text_crc32) for k, r in got.items()} == {k: (bins[item(t)], len(t) + 1, zlib.crc32(t)) for k, t in rows}
    for shard in range(8):
        slots = sorted(r.slot for r in got.values() if r.shard == shard)
        assert slots == list(range(len(slots)))


def _signed(n):
    return n - 2**64 if n >= 2**63 else n
