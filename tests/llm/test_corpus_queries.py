"""Each registered corpus query itself, over its whole table, against brute force; the pipeline against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from test_corpus import SF, brute_components, brute_fingerprint, brute_hits, brute_licenses, brute_repeats, brute_spans, brute_url, check_places, encoded, low

from gritstone.llm import packing, pii
from gritstone.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def rows(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def run(spark, name):
    df = QUERIES[name](spark, SF)
    return [r.asDict() for r in df.collect()]


def test_op1(spark, rows):
    got = run(spark, "op1_toxicity")
    assert sorted(r["doc_id"] for r in got) == [i for i, _ in rows]
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    scores = {r["doc_id"]: r["score"] for r in got}
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    toxic, clean = ([scores[i] for i, t in marks.items() if t == want and i in scores] for want in (1, 0))
    assert np.mean(toxic) > np.mean(clean)


def test_op2(spark, rows):
    got = {r["doc_id"]: r for r in run(spark, "op2_license")}
    for i, t in rows:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_licenses(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_op3(spark, rows):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, "op3_simhash")}
    f = {i: brute_fingerprint(t, 3) for i, t in rows}
    part = brute_components(f, [(a, b) for a in f for b in f if a < b and (f[a] ^ f[b]).bit_count() <= 2])
    assert got == {i: (f"{x:016x}", part[i]) for i, x in f.items()}


def test_op4(spark):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in run(spark, "op4_url_filter"):
        host, path, rule, verdict = brute_url(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (verdict is None or r["verdict"] == verdict)


def test_op5(spark, rows):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(tuple(r[n] for n in names) for r in run(spark, "op5_decontaminate")) == sorted(brute_hits(rows, items))


def test_op6(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    v, ids = np.array([r["embedding"] for r in table], float), np.array([r["vec_id"] for r in table])
    found = {}
    for r in run(spark, "op6_ann_tree"):
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(found) == sorted(i for i in ids.tolist() if i % 20 == 0)
    met = 0
    for q, near in found.items():
        near.sort()
        s = (v * v[ids == q][0]).sum(axis=1)
        best = [i for i in ids[np.lexsort((ids, -s))].tolist() if i != q][:20]
        assert [n for n, _, _ in near] == list(range(1, 21))
        assert all(x == s[ids == i][0] for _, i, x in near)
        met += len({i for _, i, _ in near} & set(best))
    assert met >= 0.9 * 20 * len(found)


def test_op7(spark, rows):
    got, at = {r["doc_id"]: r for r in run(spark, "op7_token_store")}, 0
    for (i, _), ids in zip(rows, encoded("word_bpe_49k.json", [t for _, t in rows], 1), strict=True):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def pieces(rows):
    want = set()
    for (i, _), ids in zip(rows, encoded("byte_bpe_50k.json", [t for _, t in rows], 2), strict=True):
        at = 0
        for k, n in enumerate(packing.cut_lengths(len(ids), 1024)):
            want.add((i, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            at += n
    return want


def test_op8(spark, rows):
    got = QUERIES["op8_packing"](spark, SF).toPandas()
    assert {tuple(x) for x in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)} == pieces(rows)
    check_places(got)


def test_op9(spark, rows):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in run(spark, "op9_suffix_dedup")}
    assert got == dict(zip([i for i, _ in rows], brute_repeats([(t or "").encode() for _, t in rows]), strict=True))


def brute_own(text):
    """IBANs, secrets and social security numbers, each tried at every place by plain rules."""
    out = []
    for m in re.finditer(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9])+", text):
        if re.match(r"[A-Za-z0-9]", text[m.start() - 1 : m.start()] or " "):
            continue
        for end in range(m.end(), m.start(), -1):
            body = text[m.start() : end].replace(" ", "")
            groups = re.fullmatch(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", text[m.start() : end])
            if groups and not re.match(r"[A-Za-z0-9]", text[end : end + 1]) and 15 <= len(body) <= 34:
                number = "".join(str(int(c, 36)) for c in body[4:] + body[:4])
                if int(number) % 97 == 1:
                    out.append(("iban", m.start(), end))
                break
    for m in re.finditer(r"(?i)(token|secret|password|passwd|api_key|api-key|apikey)[ \t]*[=:][ \t]*[\"']?([A-Za-z0-9/+_.-]{16,})", text):
        if not re.match(r"(?i)[a-z0-9_]", text[m.start() - 1 : m.start()] or " "):
            out.append(("secret", *m.span(2)))
    for m in re.finditer(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])", text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            near = re.findall(r"[^\W\d_]+", text[max(0, m.start() - 48) : m.start()].lower()) + re.findall(r"[^\W\d_]+", text[m.end() : m.end() + 48].lower())
            if 0.4 + 0.2 * bool({"ssn", "social", "security"} & set(near)) - 0.3 * bool({"part", "serial"} & set(near)) >= 0.5:
                out.append(("ssn", m.start(), m.end()))
    return out


def spans_of(text):
    order = ("email", "ip", "card", "phone", "iban", "secret", "ssn")
    return sorted([*brute_spans(text), *brute_own(text)], key=lambda x: (x[1], order.index(x[0]), x[2]))


def test_op10(spark, rows):
    texts = dict(rows)
    for r in run(spark, "op10_pii"):
        base = brute_spans(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(x[0] == k for x in base) for k in pii.BASE_KINDS]
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in spans_of(texts[r["doc_id"]] or ""))


@pytest.mark.parametrize("text", ["SSN 123-45-6789", "part 123-45-6789", "123-45-6789", "GB82 WEST 1234 5698 7654 32 ok", "XGB82WEST12345698765432", "token" + " " * 40 + "=" + "\t" * 30 + "abcdefghijklmnop1", "my_token=abcdefghijklmnopq", "token=short", "Password: 'aaaaaaaaaaaaaaaaaaaaaaaa'"])
def test_own_spans_against_plain_rules(text):
    assert [(s.kind, s.start, s.end) for s in pii.detect(text)] == spans_of(text)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    from oracle import compare, database

    assert compare(QUERIES[name](spark, SF), ORACLE_SQL[name], database(SF)) == ""


def test_pipeline_against_plain_python(spark, rows):
    """Scores come from the classifier's own query; everything after them is worked out anew."""
    import corpus_pipeline

    toxic = {r["doc_id"] for r in run(spark, "op1_toxicity") if r["predicted"]}
    kept = [(i, t or "") for i, t in rows if i not in toxic]
    sets = {}
    for i, t in kept:
        w = low(t).encode().split()
        sets[i] = frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) > 5 else frozenset([tuple(w)] if w else [])
    ids = list(sets)
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    group = brute_components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if alike(sets[a], sets[b])])
    kept = [(i, t) for i, t in kept if group[i] == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {i for i, *_, bad in brute_hits(kept, items) if bad}
    final = []
    for i, t in kept:
        if i not in leaked:
            out, at = "", 0
            for kind, a, b in spans_of(t):
                if a >= at:
                    out += t[at:a] + f"<{kind.upper()}>"
                at = max(at, b)
            final.append((i, out + t[at:]))
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert {tuple(x) for x in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)} == pieces(final)
    check_places(got)
