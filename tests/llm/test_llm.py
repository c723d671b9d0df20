"""The text operators against brute force, exact round trips and stated cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import history, leakage, privacy, scans, sentences, splitting, tokens

NASTY = [None, "", "   \n\t ", "x" * 5000, "字" * 1500, "á" * 900, "‫שלום‬ \\n", "😀👩‍💼 ½ ㎏", "(((“““", "...!?…", "'s's don't ''s", "\r\n\r\n"]


def nasty(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(NASTY + NASTY[3:4])], "doc_id long, text string, ids string")


def test_operators_survive_odd_texts_and_empty_tables(spark):
    df = nasty(spark)
    items = spark.createDataFrame([(1, "one two three"), (2, None), (3, "")], "item_id long, text string")
    texts = df.select(F.lit("t").alias("table_name"), F.col("doc_id").cast("string").alias("row_key"), F.col("doc_id").cast("string").alias("doc_key"), "text", F.lit(True).alias("paged"))
    for d, t in ((df, texts), (df.limit(0), texts.limit(0))):
        assert tokens.encode(d).count() == d.count()
        sentences.sentence_units(d).count()
        assert splitting.split_oversized(d, "text").filter("length(text) > 350").count() == 0
        assert leakage.leaks(d, items).count() == 0
        privacy.mentions(t.select("table_name", "row_key", "text")).count()
        found = scans.Findings(t)
        found.kinds().count()
        assert scans.repaired(t, found).count() == t.count()
    assert leakage.leaks(df, items.limit(0)).count() == 0


# ---- tokens


def test_ids_equal_the_library_and_decode(spark, sf):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(nasty(spark).select("doc_id", "text"))
    ranks = open(public.path("byte_bpe_50k.tiktoken"), "rb").read()
    rows = tokens.encode(docs, offsets=True).collect()
    texts = [r.text or "" for r in docs.collect()]
    assert [r.ids for r in rows] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert all(tokens.decode(r.ids, ranks) == x for r, x in zip(rows, texts))
    assert all(r.starts == sorted(set(r.starts)) and (not x or r.starts[0] == 0) for r, x in zip(rows, texts))


# ---- splitting


@pytest.mark.parametrize("seed", range(30))
def test_pieces_cover_the_text_within_the_limit(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word ", "longer-word ", "x" * 80, ". ", "\n\n", "字。", "á"]) for _ in range(rng.randint(1, 400))).strip(splitting.WHITE_SPACE)
    pieces = splitting.spans(text)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b - a <= 350 for a, b in pieces)
    assert all(n[0] <= p[1] and p[1] - n[0] <= 60 and n[1] > p[1] for p, n in zip(pieces, pieces[1:]))


def test_cuts_prefer_strong_boundaries():
    text = "a" * 170 + " b " + "c" * 20 + "\n\n" + "d" * 190
    assert splitting.spans(text, 350, 0)[1][0] == text.index("d")


def test_pages_are_taken_from_neighbours(spark):
    df = spark.createDataFrame([(1, 1, 0, 3), (2, 1, 1, None), (3, 1, 2, 0), (4, 2, 0, None)], "id long, document_id long, chunk_index int, page_number int")
    assert {r.id: r.page_number for r in splitting.repaired_pages(df).collect()} == {1: 3, 2: 3, 3: None, 4: None}


def test_pages_are_filled_over_gaps_and_put_in_order(spark):
    pages = {0: None, 1: 3, 2: None, 3: 0, 4: 4, 7: 1, 8: 4, 9: 99, 10: None, 11: 5, 2999: 6, 3000: None, 9000: -1}
    rows = [(i, 1, i, p) for i, p in pages.items()] + [(10001, 2, 0, None), (10002, None, 5, 7), (10003, 3, None, 8)]
    df = spark.createDataFrame(rows, "id long, document_id long, chunk_index int, page_number int")
    got = {r.id: r.page_number for r in splitting.filled_pages(df).collect()}
    assert got == {0: 3, 1: 3, 2: 3, 3: 3, 4: 4, 7: 4, 8: 4, 9: 4, 10: 4, 11: 5, 2999: 6, 3000: 6, 9000: 6, 10001: None, 10002: 7, 10003: 8}
    assert splitting.filled_pages(df.limit(0)).count() == 0


def test_pages_of_a_long_document_equal_one_pass(spark):
    rng = random.Random(5)
    true = [i // 2 + 1 for i in range(5000)]
    seen = [rng.choice([None, 0, 1, 4000]) if rng.random() < 0.05 else p for p in true]
    df = spark.createDataFrame([(i, 1, i, p) for i, p in enumerate(seen)], "id long, document_id long, chunk_index int, page_number int")
    got = [r.page_number for r in splitting.filled_pages(df).orderBy("id").collect()]
    known = [i for i, p in enumerate(seen) if p]
    wrong = {known[k] for k in splitting.out_of_order([seen[i] for i in known])}
    right = [None if i in wrong or not p else p for i, p in enumerate(seen)]
    want = [next((p for p in right[i::-1] if p), None) or next(p for p in right[i:] if p) for i in range(len(right))]
    assert got == want and sum(a != b for a, b in zip(got, true)) < sum(a != b for a, b in zip(seen, true))


@pytest.mark.parametrize("seed", range(10))
def test_fewest_pages_are_out_of_order(seed):
    rng = random.Random(seed)
    pages = [rng.randint(1, 5) for _ in range(rng.randint(0, 9))]
    left = [p for i, p in enumerate(pages) if i not in splitting.out_of_order(pages)]
    ups = [[p for i, p in enumerate(pages) if m >> i & 1] for m in range(1 << len(pages))]
    assert left == sorted(left) and len(left) == max(len(u) for u in ups if u == sorted(u))


# ---- history


def test_batches(spark):
    rows = [
        (1, 0, "Invoice", "Ondrix Ceramics Pvt Ltd", "ONC-2025-00017", "ab" * 32), (2, 1, "Invoice", "ONDRIX CERAMICS", "onc 2025/17", "01" * 32),
        (3, 1, "Invoice", "Onrdix Cerarnics, Private Limited", "Invoice No. ONC2025000I7", None), (4, 1, "Invoice", "Ondrix Foods Ltd", "ONC-2025-00017", ""),
        (5, 1, "Other", None, None, "sha256:" + "AB" * 32), (6, 2, "Resume", "Not Found", "N/A", "cd" * 32), (7, 2, "Resume", "Not Found", "N/A", "CD" * 32 + " "),
        (8, 2, "Invoice", "Ondrix Foods", "ONC-2025-00018", "cd" * 32), (9, 3, "Invoice", "Ondrix Foods", "ONC-2025-18", None), (10, 3, "Invoice", None, "ONC-2025-00017", None),
    ]
    df = spark.createDataFrame(rows, "id long, batch_no int, document_type string, company string, invoice_number string, file_hash string")
    got = {tuple(r) for r in history.repeats(df).collect()}
    # 8 repeats 6 by its file and so isn't accepted; 9 therefore repeats nothing
    assert got == {(1, 2), (1, 3), (1, 5), (6, 7), (6, 8)}
    assert history.repeats(df.limit(0)).count() == 0


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_slots_find_every_similar_name(spark):
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 13))) for _ in range(150)})
    df = spark.createDataFrame([("number", "k", n, 1, i) for i, n in enumerate(names)], "kind string, key string, name string, words int, id long")
    df = history.slotted(df)
    met = history._met(df, history._in_slots(df)).select("a.id", "b.id").distinct().collect()
    assert {tuple(r) for r in met} == {(i, j) for i, a in enumerate(names) for j, b in enumerate(names) if edits(a, b) <= 2}


def greedy(rows, same):
    accepted, out = [], set()
    for r in rows:
        hits = [a for a in accepted if same(a, r)]
        out |= {(a[0], r[0]) for a in hits}
        if not hits:
            accepted.append(r)
    return out


def test_batches_match_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(i, 1 + i // 20, "Invoice", rng.choice(["Alpha Works", "Alpha Worsk", "Beta Mills", "Beta Mils"]), f"AA-2025-{rng.randint(1, 9)}", rng.choice(["a1", "b2", "c3", "d4"]) * 16 if rng.random() < 0.3 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, batch_no int, document_type string, company string, invoice_number string, file_hash string")
    want = greedy(rows, lambda a, b: (a[5] and a[5] == b[5]) or (a[4] == b[4] and edits(a[3].replace(" ", ""), b[3].replace(" ", "")) <= 2))
    assert {tuple(r) for r in history.repeats(df).collect()} == want
    assert {tuple(r) for r in history.repeats(df, together=0).collect()} == want  # in rounds


def test_close_names_are_those_within_two_edits():
    rng = random.Random(6)
    names = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 7))) for _ in range(60)]
    assert all(history.close(a, b) == (edits(a, b) <= 2) for a in names for b in names)


# ---- leakage


def test_leaks_match_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 40)))) for k in range(12)]
    docs = []
    for d in range(120):
        words = [rng.choice(vocabulary + ["the", "of"]) for _ in range(rng.randint(0, 30))]
        part = rng.choice(items)[1].split()
        if rng.random() < 0.8:
            cut = part[: rng.randint(8, len(part))] if rng.random() < 0.4 else [w for w in part if rng.random() < 0.85]
            for _ in range(rng.randint(0, 8)):
                cut.insert(rng.randint(0, len(cut)), "zz")
            words += cut
        docs.append((d, " ".join(words + [rng.choice(vocabulary) for _ in range(5)])))

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        return row[-1]

    want = set()
    for d, text in docs:
        t = text.split()
        for k, item in items:
            w = item.split()
            runs = {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
            if any(tuple(t[i : i + 13]) in runs for i in range(len(t) - 12)) or any(common(w, t[s : s + leakage.room(len(w))]) >= leakage.need(len(w)) for s in range(len(t))):
                want.add((d, k))
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {tuple(r) for r in got} == want and want


@pytest.mark.parametrize("text", ["Naïve FAÇADE-side 17.5 units", "ｎａｉｖｅ façade-\nside 17.5 *units*", "na­ïve façade‐side <b>17.5</b> uni​ts", "naÃ¯ve fa&ccedil;ade-side, 17.5 units!"])
def test_words_are_compared_without_form(text):
    assert leakage.words_of(text) == ["naive", "facadeside", "175", "units"]


def test_alignment_score():
    assert leakage.smith_waterman(np.array([1, 2, 3, 4]), np.array([9, 1, 2, 7, 3, 4, 9])) == 4 * leakage.MATCH + leakage.GAP


def test_markup_of_any_length_is_left_out():
    assert leakage.words_of('a <div class="' + "long " * 100 + '">b</div> <!-- ' + "x " * 300 + "--> c < d") == ["a", "b", "c", "d"]
    assert len(leakage.words_of("<!-- " * 20_000)) == 0


def test_twenty_thousand_items_take_little_memory():
    rng = np.random.default_rng(2)
    names = [f"w{i}" for i in range(80_000)]
    rows = [(k, " ".join(names[i] for i in rng.integers(0, 80_000, 150))) for k in range(20_000)]
    items = leakage.Items(rows)
    aligner = leakage.Aligner(items, rng.integers(1, 1000, len(items.code)))
    arrays = [items.flat, items.starts, items.runs, items.run_item, items.run_at, aligner.seed_item, aligner.seed_start, aligner.bag_word, aligner.bag_count, aligner.bag_start]
    assert sum(a.nbytes for a in arrays) < 150 * 2**20
    edited = items.words(777).copy()
    edited[::7] = items.words(5)[0]
    assert aligner.found(edited) == {777} and aligner.found(items.words(9)[20:33]) == {9} and aligner.found(np.sort(edited)) == set()


# ---- sentences


@pytest.mark.parametrize(
    "text, units",
    [
        ("Dr. A. B. Holm met Mr. Lee at 5 p.m. in Bonn. It rained.", ["Dr. A. B. Holm met Mr. Lee at 5 p.m. in Bonn.", "It rained."]),
        ("We sold it to Veltara Inc. The price was 5.25 USD.", ["We sold it to Veltara Inc.", "The price was 5.25 USD."]),
        ('"Is it right?" asked the clerk. "It is late," he said, "but fine." Who came?', ['"Is it right?" asked the clerk.', '"It is late," he said, "but fine."', "Who came?"]),
        ("The rate (see App. B. It lists all.) rose.It fell!Then it stayed.", ["The rate (see App. B. It lists all.) rose.", "It fell!", "Then it stayed."]),
        ("Am 9. Juni kam Hr. Dr. Holm, z. B. mit Nr. 7. Danke! Wer war da?", ["Am 9. Juni kam Hr. Dr. Holm, z. B. mit Nr. 7.", "Danke!", "Wer war da?"]),
        ("Il a écrit : « Cherchez. C'est urgent ! » Puis M. Holm est parti.", ["Il a écrit : « Cherchez. C'est urgent ! »", "Puis M. Holm est parti."]),
        ("¿Quién firmó? ¡Nadie avisó! El Sr. Ruiz llegó.", ["¿Quién firmó?", "¡Nadie avisó!", "El Sr. Ruiz llegó."]),
        ("审计组写道：“报价单不见了。请查找！”会议（见附件。共两页。）在Bonn举行……谁签收？", ["审计组写道：“报价单不见了。请查找！”", "会议（见附件。共两页。）在Bonn举行……", "谁签收？"]),
        ("合計は9.5円（税込。送料別。）です。監査人は「ない。再送。」と書いた。", ["合計は9.5円（税込。送料別。）です。", "監査人は「ない。再送。」と書いた。"]),
        ("गोदाम में 7.5 टन माल है। डॉ. Holm आए॥", ["गोदाम में 7.5 टन माल है।", "डॉ. Holm आए॥"]),
        ("لم يصل المبلغ. هل تم الدفع؟ نعم.", ["لم يصل المبلغ.", "هل تم الدفع؟", "نعم."]),
        ("เราได้รับแล้ว นับได้ 34 กล่องในเดือนนี้ ใครส่ง", ["เราได้รับแล้ว", "นับได้ 34 กล่องในเดือนนี้", "ใครส่ง"]),
        ("TAX INVOICE\n\nDate: 2024-10-24\r\nTotal Due: $5.00\n\n- 14 x sensor, approx. 57.5 kg\n- 3 x pump\n\nOne line\nwraps here. Two.", ["TAX INVOICE", "Date: 2024-10-24", "Total Due: $5.00", "- 14 x sensor, approx. 57.5 kg", "- 3 x pump", "One line\nwraps here.", "Two."]),
    ],
)
def test_units(text, units):
    starts = sentences.unit_starts(text)
    assert [text[a:b].strip() for a, b in zip(starts, [*starts[1:], len(text)])] == units


# ---- privacy

PEOPLE = ["Attn: Talitha Holmgren", "Contact: Brannic Vexley", "Dear Ms. Talitha Vexley, thanks", "by Mr. Brannic Holmgren on Monday", "Attn: B. Vexley", "Frau Talitha Holmgren kam"]


def mentions_of(spark, texts, **options):
    rows = [("t", str(i), x) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "table_name string, row_key string, text string")
    found = privacy.mentions(df, **options)
    return {(int(r.row_key), r.pii_type, texts[int(r.row_key)][r.start_pos - 1 : r.end_pos - 1]) for r in found.collect()}, df, found


@pytest.mark.parametrize(
    "text, kind, hit",
    [
        ("write to Ana.Lee+x@mail.example. The order", "EMAIL", "Ana.Lee+x@mail.example"), ("at billing [at] tirmaz [dot] co [dot] test.", "EMAIL", "billing [at] tirmaz [dot] co [dot] test"),
        ("a.b @ c.test now", "EMAIL", "a.b @ c.test"), ("Tel. +44 (0)7700 900 534.", "PHONE", "+44 (0)7700 900 534"), ("call (580) 555-0130.", "PHONE", "(580) 555-0130"),
        ("au 01 99 00 38 93 ou", "PHONE", "01 99 00 38 93"), ("SSN 913-13-1881 at", "ID_NUMBER", "913-13-1881"), ("soc1al security numb€r 939 39 4240\nSkills", "ID_NUMBER", "939 39 4240"),
        ("passport no. QX7238962", "ID_NUMBER", "QX7238962"), ("lives at Flat 2, 368 Station Parade, Reddock", "ADDRESS", "Flat 2, 368 Station Parade"),
        ("Address: 19 bis rue des Tanneurs, 00647 R", "ADDRESS", "19 bis rue des Tanneurs"), ("an Hafenstraße 950, 00789 P", "ADDRESS", "Hafenstraße 950"),
    ],
)
def test_shapes(text, kind, hit):
    assert [(k, text[a:b]) for k, a, b in privacy.shaped(text)] == [(kind, hit)]


@pytest.mark.parametrize("text", ["PO-364-88-1282 replaces 5363-88-4161", "Serial 6513-3213-6030-4109", "NTN 1614350-6", "Bank account 432703991250", "Firmware 10.64.89.4", "on 2026-09-25", "in Harstead only"])
def test_other_numbers_are_no_mentions(text):
    assert privacy.shaped(text) == []


@pytest.mark.parametrize("send", [0, 1000])
def test_names_are_learnt_from_protected_contexts(spark, send):
    texts = PEOPLE + ["Brannic Holmgren lives here.", "VEXLEY, TALITHA signed", "Holmgren & Sons Co delivered to Vexley Brothers Ltd.", "Copper Valley Pumps shipped."]
    got, df, found = mentions_of(spark, texts, terms_to_send=send)
    assert {(6, "NAME", "Brannic Holmgren"), (7, "NAME", "VEXLEY, TALITHA"), (4, "NAME", "B. Vexley"), (0, "NAME", "Talitha Holmgren")} <= got
    assert not {i for i, _, _ in got} & {8, 9}
    clean = {r.row_key: r.text_redacted for r in privacy.redacted(df, found).collect()}
    assert clean["6"] == "[NAME] lives here." and clean["9"] == texts[9]


# ---- scans

CLEAN = ["The warehouse confirmed the delivery of the network switch and the optical sensor before noon.", "The committee approved the remaining statement between two meetings of the department."] * 4


def kinds_of(spark, chunks, previews=()):
    rows = [("rag_chunks", str(i), "d", t, True) for i, t in enumerate(chunks)] + [("doc_records", str(i), f"p{i}", t, False) for i, t in enumerate(previews)]
    df = spark.createDataFrame(rows, "table_name string, row_key string, doc_key string, text string, paged boolean")
    found = scans.Findings(df)
    return {(r.table_name, int(r.row_key), r.noise_kind) for r in found.kinds().collect()}, {(r.table_name, int(r.row_key)): r.text_repaired for r in scans.repaired(df, found).collect()}


def test_noise_is_found_and_repaired(spark):
    head = "Veltara Insurance Inc | Lease Agreement 946 | Confidential"
    chunks = CLEAN + [f"{head}\nThe ware-\nhouse c0nfirmed the del!very.", f"The committee approvecl the\n{head.upper()}\nstaternent.\n\n- 2 -", "Pre- and post-delivery checks are listed on page 73.", "Acme Works Ltd | Memo 3 | Confidential\nThe statement."]
    got, fixed = kinds_of(spark, chunks, ["The net- work switch [3] was app­ roved, see page 6 of the annex.", f"{head} The sensor. {head} The switch."])
    n = len(CLEAN)
    assert got == {("rag_chunks", n, k) for k in ("header", "hyphen", "confusion")} | {("rag_chunks", n + 1, k) for k in ("header", "confusion", "page_number")} | {
        ("doc_records", 0, "hyphen"), ("doc_records", 0, "page_number"), ("doc_records", 1, "header"),
    }
    assert fixed["rag_chunks", n] == "The warehouse confirmed the delivery."
    assert fixed["rag_chunks", n + 1] == "The committee approved the statement."
    assert fixed["rag_chunks", n + 2] == chunks[n + 2]


def test_editor_restores_held_out_words():
    words = sorted({w for t in CLEAN for w in scans._WORDS.findall(t.lower()) if len(w) >= 4})
    editor = scans.Editor().train(words)
    assert "delivery" in editor.corrections("del!very") and "statement" in editor.corrections("staternent")
    right = 0
    spoilt = [(w, w.replace("e", "€", 1)) for w in ("receipt", "shelf", "inspection", "presence")]
    for w, s in spoilt:
        right += editor.corrections(s)[:1] == [w]
    assert right == len(spoilt)


# ---- histories that outlive a session


def test_a_history_is_reopened_and_carried_on(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, i // 30, "Invoice", rng.choice(["Alpha Works", "Alpha Worsk", "Beta Mills", "Gamma Tools"]), f"AA-2025-{rng.randint(1, 60)}", rng.choice(["a1", "b2", "c3", "d4", "e5"]) * 16 if rng.random() < 0.2 else None) for i in range(1, 330)]
    df = spark.createDataFrame(rows, "id long, batch_no int, document_type string, company string, invoice_number string, file_hash string")
    history.repeats(df.filter("batch_no < 10"), history=-1, root=f"file://{tmp_path}/h").count()
    again = history.History(spark, f"file://{tmp_path}/h")
    assert again.version > 0 and again.runs
    got = {tuple(r) for r in again.take(df.filter("batch_no = 10")).collect()}
    want = greedy(rows, lambda a, b: (a[5] and a[5] == b[5]) or (a[4] == b[4] and edits(a[3].replace(" ", ""), b[3].replace(" ", "")) <= 2))
    assert got == {(a, b) for a, b in want if b >= 300} and {tuple(r) for r in again.links().collect()} == want
    # merged runs leave no files, and tiers stay short
    assert len(list((tmp_path / "h" / "runs").iterdir())) == len(again.runs) < 8


def test_only_files_in_the_range_of_the_batch_are_read(spark, tmp_path):
    store = history.History(spark, str(tmp_path / "h"))
    schema = "kind string, key string, name string, words int, id long"
    slotted = lambda rows: history.slotted(spark.createDataFrame(rows, schema))
    for k in range(3):
        store.add(slotted([("digest", f"{i:08d}", "", 0, i) for i in range(k * 4000, k * 4000 + 4000)]))
    files = store.files()
    windows = history.Windows(files)
    places = [f"d\t{i:08d}\t" for i in range(5000, 5010)]
    rows = sum(t.filter(history.pc.is_in(t["place"], value_set=history.pa.array(places))).num_rows for t in windows.of(places))
    assert rows == 10 and len(windows.opened) <= 2 < len(files)
    new = slotted([("digest", f"{i:08d}", "", 0, 20000 + i) for i in (7, 4100, 11999, 12000)])
    assert {tuple(r) for r in store.repeated(new).collect()} == {(7, 20007), (4100, 24100), (11999, 31999)}
    assert "Exchange rangepartitioning" in store.repeated(new)._jdf.queryExecution().toString()


def test_records_without_batch_come_last(spark):
    rows = [(1, 0, "ab"), (2, None, "ab"), (3, 1, "cd"), (4, None, "cd"), (5, None, "ef"), (6, None, "ef")]
    df = spark.createDataFrame([(i, b, "Other", None, None, h * 32) for i, b, h in rows], "id long, batch_no int, document_type string, company string, invoice_number string, file_hash string")
    assert {tuple(r) for r in history.repeats(df).collect()} == {(1, 2), (3, 4), (5, 6)}


# ---- sentence properties


def test_every_sentence_terminal_ends_a_sentence():
    import sys

    import regex

    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and regex.match(r"\p{Sentence_Terminal}", chr(c))]
    assert len(every) == 172
    assert [c for c in every if sentences.unit_starts(f"Some words here{c} More words there{c}") != [0, 17]] == []


@pytest.mark.parametrize("text", ["(" * 100_000, "“" * 100_000, "'a " * 50_000, "a." * 50_000, " " * 100_000 + "x.", "“a ‘b (c " * 20_000])
def test_hostile_blocks_take_linear_time(text):
    import time

    began = time.process_time()
    sentences.unit_starts(text)
    assert time.process_time() - began < 0.5


@pytest.mark.parametrize(
    "text, units",
    [
        ("M. Holm et Mme Lee ont signé. Pourquoi M. Ruiz n'a-t-il pas reçu la relance ? Le stock reste.", 3),
        ("See Mr." + " " * 40 + "B. Holm of " + "x" * 60 + ". He left.", 2),
        ("Am" + " " * 30 + "9. Juni kam er. Dann ging er.", 2),
        ("A. Scope of work\nB. Terms of payment", 2),
        ("It rose by “five〕 (see A. Then B.) today. It fell.", 2),
    ],
)
def test_units_beyond_short_look_back(text, units):
    assert len(sentences.unit_starts(text)) == units


# ---- scans beyond the bounds of the first editor


def test_words_with_any_number_of_misread_characters_are_found(spark):
    words = "The indivisibility of commercial commitments and memoranda was confirmed in the settlement today."
    chunks = [words] * 6 + ["The 1nd1v1s1b1l1ty of cornrnercial cornrnitrnents ancl rnernoranda vvas confirmed."]
    got, fixed = kinds_of(spark, chunks)
    assert got == {("rag_chunks", 6, "confusion")}
    assert fixed["rag_chunks", 6] == "The indivisibility of commercial commitments and memoranda was confirmed."


def test_the_editor_keeps_words_whose_edits_are_no_words():
    counts = {"clause": 50, "corner": 40, "modern": 60, "statement": 90, "delivery": 80, "warehouse": 70, "committee": 75, "internal": 66, "include": 59, "return": 91}
    editor = scans.Editor().train(counts)
    assert all((editor.correction(w, x, counts[w], 0) or -1) < 0 for w, x in (("clause", "dause"), ("corner", "comer"), ("modern", "modem")))
    assert editor.correction("staternent", "statement", 1, 90) > 0 and editor.correction("statement", "staternent", 90, 1) is None
    assert editor.correction("corner", "comer", 40, 45) < 0  # two words of their own


def test_long_headers_and_page_lines_count(spark):
    head = "Veltara Insurance Inc | Lease Agreement 946 | " + " | ".join(f"Part {i} Confidential Matter" for i in range(8))
    number = "-" * 20 + " Page 3 of 9 " + "-" * 20
    got, fixed = kinds_of(spark, [f"{head}\nThe pump failed.\n{number}", f"{head}\nThe valve failed.", "A page of its own text."])
    assert len(head) > 120 and got == {("rag_chunks", 0, "header"), ("rag_chunks", 0, "page_number"), ("rag_chunks", 1, "header")}
    assert fixed["rag_chunks", 0] == "The pump failed."


def test_repeated_headers_take_few_steps():
    import time

    head = "Veltara Insurance Inc | Lease Agreement | Confidential"
    text = f"{head} some words {head} others {head} end"
    assert [text[a:b] for a, b in scans.repeated_header(text)] == [head] * 3
    began = time.process_time()
    assert scans.repeated_header("word " * 5000) == [] and scans.repeated_header("a b c d e f " * 2000) == []
    assert time.process_time() - began < 3


def test_furniture_is_told_by_place_and_shape():
    pages = [(f"d{d}", f"{d}-{p}", f"Acme Works Ltd | Memo {d} | Confidential\nThe pump of the plant failed and\nwas repaired by noon.\nTotal: 5\n- {p} -") for d in range(8) for p in range(3)]
    told = scans.Furniture().train(pages)
    assert told.says("Beta Mills Ltd | Report 3 | Confidential", "top 0") and told.says("- 7 -", "foot 0")
    assert not told.says("The valve of the plant failed and", "body") and not told.says("Total: 9", "foot 1")


# ---- privacy beyond short look-back


def test_long_local_parts_and_distant_contexts_count(spark):
    long = "a" * 200 + "@mail.example"
    assert [(k, b - a) for k, a, b in privacy.shaped(f"write to {long} now")] == [("EMAIL", len(long))]
    texts = [*PEOPLE, "Dear" + " " * 60 + "Ms. Talitha Vexley, hello", "Attention :" + "\n" * 50 + "Brannic Holmgren"]
    got, _, _ = mentions_of(spark, texts)
    assert {(6, "NAME", "Talitha Vexley"), (7, "NAME", "Brannic Holmgren")} <= got


def test_many_mentions_take_linear_time():
    import time

    text = "call (580) 555-0130 or a.b@c.test " * 10_000
    began = time.process_time()
    assert len(privacy.shaped(text)) == 20_000 and time.process_time() - began < 3


def test_the_join_gives_what_the_set_of_terms_gives_on_whole_tables(spark, sf):
    from folioforge.llm.queries import _pii_texts

    texts = _pii_texts(spark, sf)
    assert {tuple(r) for r in privacy.mentions(texts, 0).collect()} == {tuple(r) for r in privacy.mentions(texts).collect()}


def test_vocabularies_of_equal_length_do_not_mix(spark, tmp_path):
    import base64

    def ranks(order):
        rows = [bytes([i]) for i in range(256)] + [x.encode() for x in order]
        return b"\n".join(base64.b64encode(x) + b" " + str(i).encode() for i, x in enumerate(rows))

    (tmp_path / "a.tiktoken").write_bytes(ranks(["ab", "cd"]))
    (tmp_path / "b.tiktoken").write_bytes(ranks(["cd", "ab"]))
    df = spark.createDataFrame([(1, "abcd")], "doc_id long, text string").coalesce(1)
    assert [tokens.encode(df, tokenizer=t, directory=str(tmp_path)).first().ids for t in "abab"] == [[256, 257], [257, 256]] * 2


def test_items_in_several_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(200)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(25))) for k in range(20)]
    docs = [(d, " ".join(rng.choice(vocabulary) for _ in range(10)) + " " + " ".join(w for w in items[d % 20][1].split() if rng.random() < 0.92)) for d in range(60)]
    i, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    once = {tuple(r) for r in leakage.leaks(d, i).collect()}
    monkeypatch.setattr(leakage, "ITEMS_AT_ONCE", 6)
    assert {tuple(r) for r in leakage.leaks(d, i).collect()} == once and len(once) > 20


def test_repeated_rows_are_redacted_and_repaired_once(spark, tmp_path):
    from folioforge.llm import queries

    chunk = (1, 5, 0, 1, "Attn: Talitha Holmgren wrote to a.b@c.test on the ware-\nhouse.", 9)
    schema = "id long, document_id long, chunk_index int, page_number int, chunk_text string, token_count int"
    spark.createDataFrame([chunk] * 3 + [(2, 5, 1, 1, None, 0), (3, 5, 2, 1, "", 0)], schema).write.parquet(str(tmp_path / "rag_chunks.parquet"))
    spark.createDataFrame([], "id long, text_preview string").write.parquet(str(tmp_path / "doc_records.parquet"))
    spark.createDataFrame([], "id string, text string").write.parquet(str(tmp_path / "documents_corpus.parquet"))
    got = {r.row_key: r.text_redacted for r in queries.p3_redacted(spark, str(tmp_path)).collect()}
    assert got["1"].startswith("Attn: [NAME] wrote to [EMAIL] on") and got["2"] is None and got["3"] == ""
    assert queries.p3_redacted(spark, str(tmp_path)).count() == 3
    rows = queries.p6_repaired(spark, str(tmp_path)).collect()
    assert len(rows) == 3 and {r.row_key: r.text_repaired for r in rows}["2"] is None
