import re

import xxhash

from tessera.llm import simhash

SCHEMA = "doc_id long, text string, fp string, n int, root string"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute(rows):
    fps = {}
    for d, t in rows:
        fps.setdefault(plain_fingerprint(t), []).append(d)
    keys, seen, comp = list(fps), set(), {}
    for k in keys:
        if k in seen:
            continue
        todo, group = [k], []
        seen.add(k)
        while todo:
            x = todo.pop()
            group.append(x)
            for y in keys:
                if y not in seen and (x ^ y).bit_count() <= 3:
                    seen.add(y)
                    todo.append(y)
        ids = [d for g in group for d in fps[g] if d is not None]
        for g in group:
            comp[g] = min(ids, default=None)
    return sorted(((d, f"{plain_fingerprint(t):016x}", comp[plain_fingerprint(t)]) for d, t in rows), key=str)


def answer(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA)
    out = simhash.near_duplicates(docs).select("doc_id", simhash.hex16().alias("f"), "component_id")
    return sorted(map(tuple, out.collect()), key=str)


def test_against_brute_force_with_edge_cases(spark):
    base = "the quick brown fox jumps over the lazy dog while seven wizards brew potions " * 12
    rows = [(5, base), (3, base + "x"), (9, base.upper()), (9, base.upper()), (7, None), (2, ""), (8, " \t\n"), (None, base), (None, "un seul"), (11, "É é ß"), (12, "one two"), (13, "word " * 30000)]
    rows += [(100 + i, base + f" tail{i}") for i in range(40)]
    assert answer(spark, rows) == brute(rows)


def test_sf_documents_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert answer(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert answer(spark, []) == []


def test_chunked_bucket_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 4)
    values = sorted({0b1111 << s for s in range(30)} | {(1 << i) for i in range(30)} | {0})
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    from tessera.llm.tables import components, shared_folder

    out = components(simhash.links(fps, 3), shared_folder(spark)).collect()
    assert {r.root for r in out} == {0} and len(out) == len(values)


def test_masks_cover_every_close_pair():
    import itertools

    for bits in itertools.combinations(range(0, 64, 5), 3):
        x = sum(1 << b for b in bits)
        assert any((x & (m & (1 << 64) - 1)) == 0 for m in simhash.masks(3))
