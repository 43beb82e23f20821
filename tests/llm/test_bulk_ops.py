"""Transport streams, pages, records, packing, SimHash and the pipeline against brute force and round trips."""

import random
import struct
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from driftwatch.llm import classifier, components, packing, pages, queries, records, rules, simhash, transport
from driftwatch.llm.tokens import default_vocabulary, text_encoder
from driftwatch.session import fresh_path

DOC = "doc_id long, text string"
LONG = "Ein langer Text. " * 6_000
ODD = [(3, None), (1, ""), (2, "x"), (5, LONG), (4, "zwei\nZeilen. Und <|endoftext|> mehr"), (4, "zwei\nZeilen. Und <|endoftext|> mehr"), (None, "é" * 700)]


def test_streams_round_trip(frame):
    got = transport.read(transport.store(frame([(i, t, "x") for i, t in ODD], DOC + ", feature string"))).collect()
    assert len(got) == len(ODD)
    for r in got:
        data = (r["text"] or "").encode()
        want = data + b"\xff" * (-len(data) % 576 or (576 if not data else 0))
        assert r["payload_bytes"] == len(want) and len(want) % 576 == 0
        assert r["payload_sha256"] == sha256(want).hexdigest() and r["tail_crc32"] == zlib.crc32(want[-32:])
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == sha256(bytes(r["media"])).hexdigest()
        assert r["timestamps"] == [i * 16 * transport.TICKS for i in range(len(r["timestamps"]))] and r["random_access"][0] == 0
        assert " gaps=0 " in r["feature"]


def test_null_and_broken_streams_read_as_nulls(frame):
    good = transport.mux(b"x" * 576)
    bad = [good[:-1], b"", good[:188], bytes(188), good[188:], b"G" + bytes(187)]
    got = transport.read(frame([(0, None), (1, good), *((2 + i, x) for i, x in enumerate(bad))], "doc_id long, media binary")).orderBy("doc_id").collect()
    assert got[0]["payload_bytes"] is None and got[0]["feature"] is None and got[0]["error"] is None and got[1]["payload_bytes"] == 576
    assert all(r["error"] and r["payload_sha256"] is None for r in got[2:])
    assert transport.read(transport.store(frame([], DOC))).count() == 0


def test_streams_are_read_packet_by_packet():
    """What a plain reader of packets finds equals what the operator says."""
    random.seed(5)
    payload = random.randbytes(576 * 300)
    media = transport.mux(payload)
    tables, units, counters, points, clocks, gaps = [], [], {}, [], [], 0
    for at in range(0, len(media), 188):
        packet = media[at : at + 188]
        pid, control = (packet[1] & 31) << 8 | packet[2], packet[3] >> 4 & 3
        gaps += pid in counters and packet[3] & 15 != (counters[pid] + 1) % 16
        counters[pid] = packet[3] & 15
        begin = 5 + packet[4] if control & 2 else 4
        if pid != transport.MEDIA_PID:
            tables.append((pid, packet[5:]))
            continue
        if packet[1] & 0x40:
            if control & 2 and packet[4] and packet[5] & 0x40:
                points.append(len(units))
                clocks.append(int.from_bytes(packet[6:11]) >> 7)
            units.append(b"")
        units[-1] += packet[begin:]
    assert {pid for pid, _ in tables} == {0, transport.PMT_PID} and not gaps
    times, parts = [], []
    for unit in units:
        assert unit[:4] == b"\0\0\1" + bytes([transport.STREAM_ID]) and int.from_bytes(unit[4:6]) == len(unit) - 6
        bits = int.from_bytes(unit[9:14])
        times.append((bits >> 33 & 7) << 30 | (bits >> 17 & 0x7FFF) << 15 | bits >> 1 & 0x7FFF)
        parts.append(unit[9 + unit[8] :])
    stream = transport.Stream(media)
    assert b"".join(parts) == payload == stream.payload and times == stream.timestamps and clocks == stream.clocks == [times[i] for i in points]
    assert points == [i for i, flag in enumerate(stream.random_access) if flag]
    mean = sum(payload) // len(payload)
    variance = (sum(x * x for x in payload) * len(payload) - sum(payload) ** 2) // len(payload) ** 2
    assert stream.feature() == f"packets={len(media) // 188} units={len(units)} random={len(points)} first={times[0]} last={times[-1]} gaps=0 mean={mean} variance={variance}"


def test_streams_of_all_lengths_and_broken_ones():
    random.seed(1)
    for n in [*range(1, 40), 1000, 4999]:
        payload = random.randbytes(576 * n)
        media = transport.mux(payload)
        assert transport.Stream(media).payload == payload
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    whole = transport.Stream(media)
    assert sum(whole.random_access) == -(-len(whole.timestamps) // transport.RANDOM_EVERY)
    with pytest.raises(ValueError):
        transport.Stream(b"".join([*packets[:9], *packets[10:]]))
    with pytest.raises(ValueError):
        transport.Stream(media[:-1])
    swapped = bytearray(media)
    swapped[188 * 5 + 3] ^= 1
    assert transport.Stream(bytes(swapped)).discontinuities == 2
    swapped[8] ^= 1
    with pytest.raises(ValueError):
        transport.Stream(bytes(swapped))


def extracted(frame, rows, parts=1):
    got = pages.extract(frame(rows, "page_id long, url string, html string, text int", parts)).collect()
    return {r["page_id"]: r["text"] for r in got}


def test_pages_by_marks(frame):
    html = (
        '<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Top</header><nav><ul><li>Menu</li></ul></nav>'
        '<div class="cookie-notice">We use</div><article><h1>Head</h1><p>One &amp; two&nbsp;  three<br>four<p>F<b>iv</b>e</p><div class="ad">Buy</div><form>Name</form></article>'
        '<section id="comments"><p>First!</p></section><article class="comment">Second!</article><aside>More</aside><!-- x --><footer>&copy; me</footer></body></html'
    )
    rows = [(1, "http://h/a", html, 1), (2, None, None, 1), (3, "no url", "", 1), (4, "http://h/b", html, 1), (5, "http://g/x", "<p>a &am", 1), (6, "http://g/y", "2 < 3 <script>x", 1)]
    got = extracted(frame, rows)
    assert got == {1: "Head One & two three four Five", 4: "Head One & two three four Five", 2: "", 3: "", 5: "a &am", 6: "2 < 3"}
    assert pages.extract(frame([], "page_id long, url string, html string")).count() == 0


def test_pages_by_differencing(frame):
    page = lambda body: f"<body><div>Site name</div><p>{body}</p><div>All about us</div></body>"
    rows = [(i, f"https://h.org/news/{i}", page(f"Story {i}"), 0) for i in range(4)] + [(9, "https://other.org/1", page("Alone"), 0)]
    got = extracted(frame, rows)
    assert {got[i] for i in range(4)} == {f"Story {i}" for i in range(4)} and got[9] == "Site name Alone All about us"
    copies = [(i, f"https://h.org/{i}", page("Same"), 0) for i in range(2)]
    assert set(extracted(frame, copies).values()) == {"Site name Same All about us"}  # no page to difference them with


def test_common_lines_are_a_longest_subsequence():
    def longest(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    random.seed(8)
    for _ in range(500):
        a, b = ([random.choice("abcd") for _ in range(random.randint(0, 14))] for _ in range(2))
        found = pages.common_lines(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in sorted(found)) and len(found) == longest(a, b)


def test_all_pages_give_their_article(spark):
    import html
    import re

    rows = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    got = {r["page_id"]: r for r in queries.op5_page_text(spark, SMALL).collect()}
    assert len(got) == len(rows)
    for r in rows:
        body = r["html"].split("<article>")[1].split("</article>")[0]
        want = " ".join(html.unescape(re.sub(r"</?(p|h1|br)>", " ", body.replace("<b>", "").replace("</b>", ""))).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_checksums_are_crc32c():
    def slow(data):
        value = 0xFFFFFFFF
        for byte in data:
            value ^= byte
            for _ in range(8):
                value = value >> 1 ^ (records.POLYNOMIAL if value & 1 else 0)
        return value ^ 0xFFFFFFFF

    random.seed(3)
    parts = [b"123456789", b"", *(random.randbytes(n) for n in (1, 3, 4, 255, 256, 257, 512, 700, 5000))]
    crc = [slow(p) for p in parts]
    assert crc[0] == 0xE3069283
    assert records.checksums(parts).tolist() == [((c >> 15 | c << 17) + records.MASK_DELTA) & 0xFFFFFFFF for c in crc]


def test_broken_records_are_found():
    made = records.frames([b"one", b"", b"three" * 200, *(b"%d" % i for i in range(300))])
    assert all(f[-1] == 10 for f in made) and len({f[-4:] for f in made}) > 290
    data = b"".join(made[:3])
    assert [p[:-4] for p in records.read_frames(data)[1]] == [b"one", b"", b"three" * 200]
    for i in (0, 9, 13, len(data) - 1):
        broken = bytearray(data)
        broken[i] ^= 1
        with pytest.raises(ValueError):
            records.read_frames(bytes(broken))
    with pytest.raises(ValueError):
        records.read_frames(data[:-3])


def test_records_round_trip_in_order(spark, frame):
    paths, encoder = default_vocabulary(), text_encoder(*default_vocabulary())
    rows = [*ODD, *((100 - i, f"text number {i}\n" * (i % 7)) for i in range(60))]
    path = fresh_path(spark, "records")
    records.write_records(frame([(i, t, "x") for i, t in rows], DOC + ", frame string"), path, *paths)
    index = records.write_index(spark, path, *paths)
    for file in {r["file"] for r in index.select("file").distinct().collect()}:  # a plain reader of frames
        with open(file.removeprefix("file:"), "rb") as content:
            while head := content.read(8):
                sums, body = content.read(4), content.read(struct.unpack("<Q", head)[0])
                assert records.checksums([head, body]).astype("<u4").tobytes() == sums + content.read(4)
    got = records.with_starts(index).collect()
    got.sort(key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids[0] is None and ids[1:] == sorted(i for i, _ in rows if i is not None)
    start, texts = 0, defaultdict(list)
    for i, t in rows:
        texts[i].append(t or "")
    for r in got:
        want = [np.append(encoder.encode(t), np.uint32(2)).astype("<u4") for t in texts[r["doc_id"]]]
        assert (r["n_tokens"], r["ids_crc32"]) in [(len(w), zlib.crc32(w.tobytes())) for w in want] and r["start"] == start
        start += r["n_tokens"]
        with open(r["file"].removeprefix("file:"), "rb") as file:  # a shuffled read by the index
            file.seek(r["offset"])
            head = struct.unpack("<Q", file.read(8))[0]
            file.read(4)
            one, tokens = records.read_payload(file.read(head), False)
        assert head == r["length"] and one == r["doc_id"] and len(tokens) == r["n_tokens"]
    empty = fresh_path(spark, "records")
    records.write_records(frame([], DOC), empty, *paths)
    nothing = records.write_index(spark, empty, *paths)
    assert records.with_starts(nothing).count() == 0
    assert records.read_records(spark, nothing, empty, *paths).count() == 0
    some = index.where("number % 2 = 0").unionByName(index.where("number = 0"))
    expected = sorted((r["file"], r["offset"], r["doc_id"] or 0, r["ids_crc32"]) for r in some.collect())
    back = records.read_records(spark, some, path, *paths).collect()
    assert sorted((r["file"], r["offset"], r["doc_id"] or 0, zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in back) == expected


def packed_whole(rows, pieces, size):
    encoder = text_encoder(*default_vocabulary())
    parts, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        parts[p["doc_id"], p["doc_tokens"]].append(p)
        sequences[p["sequence_id"]].append(p)
    assert sum(p["length"] for p in pieces) == sum(len(encoder.encode(t or "")) + 1 for _, t in rows)
    for i, t in rows:
        ids = np.append(encoder.encode(t or ""), np.uint32(0)).astype("<u4")
        for p in parts[i, len(ids)]:
            assert p["ids_crc32"] in (zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()),) or [x for x, _ in rows].count(i) > 1
        starts = sorted((p["start"], p["length"]) for p in parts[i, len(ids)])
        assert sum(n for _, n in starts) % len(ids) == 0 and starts[0][0] == 0
    for own in sequences.values():
        own.sort(key=lambda p: p["offset"])
        at = 0
        for p in own:
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= size
    return len(sequences)


@pytest.mark.parametrize("size", [16, 1024])
def test_packing_keeps_every_id(frame, size):
    rows = [*ODD, *((10 + i, f"Sentence number {i}. And one more!\n" * (i % 9)) for i in range(50))]
    pieces = packing.pack(frame([(i, t, 1) for i, t in rows], DOC + ", length int", 2), *default_vocabulary(), size=size, run_tokens=4_000).collect()
    packed_whole(rows, pieces, size)
    assert packing.pack(frame([], DOC), *default_vocabulary()).count() == 0


def test_packing_has_little_padding(spark):
    sf = SMALL.replace("0.001", "0.01")
    pieces = queries.op7_packing(spark, sf).collect()
    n = packed_whole([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()], pieces, 1024)
    assert sum(p["length"] for p in pieces) / (n * 1024) > 0.96


def test_only_long_sentences_are_cut_inside(frame):
    rows = [(i, "A sentence of some words that ends here. " * (1 + i % 5)) for i in range(40)] + [(99, "no end " * 200)]
    pieces = packing.pack(frame(rows, DOC, 2), *default_vocabulary(), size=64).collect()
    encoder = text_encoder(*default_vocabulary())
    inside = 0
    for p in pieces:
        ids = encoder.encode(dict(rows)[p["doc_id"]])
        end = p["start"] + p["length"]
        if end < p["doc_tokens"] and not encoder.quick.decode_single_token_bytes(int(ids[end - 1])).endswith(packing.ENDS):
            inside += 1
            assert p["doc_id"] == 99
    assert inside


def test_cuts_are_the_best():
    random.seed(6)
    for _ in range(200):
        size, places = random.randint(3, 20), [0]
        while len(places) < 25:
            places.append(places[-1] + random.randint(1, min(size, 6)))
        costs = [0.0, *(random.choice([0.0, 4.0, 40.0]) for _ in places[1:])]
        best = [0.0] + [float("inf")] * 24
        for j in range(1, 25):
            for i in range(j):
                if places[j] - places[i] <= size:
                    best[j] = min(best[j], best[i] + size - places[j] + places[i] + (costs[j] if j < 24 else 0))
        cuts = packing.best_cuts(np.array(places), np.array(costs), size)
        steps = np.diff([0, *cuts])
        assert cuts[-1] == places[-1] and (steps <= size).all()
        assert best[-1] == sum(size - s for s in steps) + sum(costs[places.index(c)] for c in cuts[:-1])


def fingerprint_brute(text):
    words = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def joined(values, links):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


def near_brute(values):
    return [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 2]


@pytest.mark.parametrize("dense,vast", [(256, 1 << 18), (3, 1 << 18), (3, 5)])
def test_links_keep_all_components(dense, vast, monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", dense)
    monkeypatch.setattr(simhash, "VAST", vast)
    random.seed(dense + vast)
    values = set()
    bases = [random.getrandbits(64) for _ in range(5)]
    while len(values) < 700:
        v = random.choice(bases)
        for _ in range(random.randint(0, 5)):
            v ^= 1 << random.choice([random.randrange(64), random.randrange(8)])
        values.add(v)
    values = sorted(values)
    array = np.array(values, np.uint64)
    keys, rows = simhash.ring_keys(array).ravel(), np.repeat(array, 16)
    order = np.lexsort((rows, keys))
    a, b = simhash.bucket_links(keys[order], rows[order])
    assert joined(values, zip(a.tolist(), b.tolist(), strict=True)) == joined(values, near_brute(values))


def test_near_duplicates_equal_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:40])] + [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "One two"), (2004, "one TWO"), (2004, "one TWO"), (None, "one two"), (2005, LONG)]
    random.seed(4)
    for i in range(60):  # near copies of one long text
        words = rows[0][1].split(" ")
        words[random.randrange(len(words))] = "changed"
        rows.append((3000 + i, " ".join(words)))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], DOC + ", fp string").repartition(5)
    got = simhash.near_duplicates(docs).collect()
    prints = [(i, fingerprint_brute(t or "")) for i, t in rows]
    roots = joined(sorted({f for _, f in prints}), near_brute(sorted({f for _, f in prints})))
    smallest = defaultdict(list)
    for i, f in prints:
        smallest[roots[f]] += [] if i is None else [i]
    want = sorted((str(i), f"{f:016x}", min(smallest[roots[f]])) for i, f in prints)
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == want
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, f in prints if i is None or min(smallest[roots[f]]) == i)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(100)] + [(500, 501), (501, 500), (7, 7)]
    random.shuffle(chain)
    got = components.components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert sorted((r["node"], r["component"]) for r in got) == [(i, 0) for i in range(1, 101)] + [(501, 500)]


def test_pipeline_equals_its_stages_by_brute_force(spark):
    docs, marks = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    trees, (forest, cut) = classifier.fit(docs, marks), rules.fit(docs, marks)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = {i: t for i, t in rows.items() if trees.score(np.array([classifier.document_statistics(t)]))[0] >= 0.3}

    def passes(t):
        c = rules.rule_counts(t)
        features = np.array([rules.rule_features(t, c)])
        return c[0] >= 50 and 100 * c[4] <= 50 * c[0] and forest.score(features)[0] <= cut

    rows = {i: t for i, t in rows.items() if passes(t)}
    from test_text_ops import lines_brute

    rows = {int(i): t for i, t, _, _ in lines_brute(list(rows.items()))}
    from test_neardup import brute

    rows = {i: rows[i] for i, first in brute([*rows.items()]) if i == first}
    stage, columns = docs, docs.columns
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, SMALL)
        assert stage.columns == columns
    assert {r["doc_id"]: r["text"] for r in stage.collect()} == rows and 0 < len(rows) < docs.count()
    assert stage.where(F.col("n_chars") != F.length("text")).count() == 0
    packed_whole(list(rows.items()), corpus_pipeline.run(spark, SMALL).collect(), 1024)
