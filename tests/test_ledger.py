from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import text as T
from tallyspark.functions.period import Selection, add_months, parse_mode, parse_period, validate
from tallyspark.operators import extraction as X
from tallyspark.operators import maintenance as M
from tallyspark.operators import merchants as C
from tallyspark.operators import recurring as R
from tallyspark.operators import rollups as A
from tallyspark.plans.dashboard import summary, totals_map
from tallyspark.sources import model


def each(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("c"))).collect()]


def test_normalize(spark):
    cases = {
        "MCDONALDS SUC 12": "mcdonalds", "LIDER COM 3": "lider", "S.A. PARIS 03/06": "paris 03/06", "CINEMARK": "cinemark", "CAFÉ / AÉROPORT": "cafe aeroport",
        "EMPRESA S.A.C.": "empresa", "EMPRESA SpA": "empresa", "   ": "", "LIDER, 1/2 3/4": "lider 1/2 3/4",
    }
    assert each(spark, cases, T.normalize_merchant) == list(cases.values())


def test_amounts(spark):
    cases = [
        ("$ 1.234.567", "CLP", D("1234567.00")), ("$ -100.000", "CLP", D("-100000.00")), ("US$ 1.234,56", "USD", D("1234.56")), ("US$ -1.234,56", "usd", D("-1234.56")), ("US$ 236,86", "USD", D("236.86")),
        ("+ $ 1.234.567", "CLP", D("1234567.00")), ("$ 4250", "CLP", D("4250.00")), ("US$ 0,00", "USD", D("0.00")), ("1.2.3.4", "CLP", None), ("12,5", "CLP", None), ("", "CLP", None), (None, "CLP", None), ("5", "EUR", None),
        ("1234.567", "CLP", D("1234567.00")), ("1234.567,8", "USD", D("1234567.80")), ("abono, $ 5", "CLP", D("5.00")), ("1.23", "CLP", None), ("US$ 1 US$ 5", "USD", D("5.00")), ("$ 1 $ 5", "CLP", None), ("-", "CLP", None),
    ]
    df = spark.createDataFrame([(i, a, c) for i, (a, c, _) in enumerate(cases)], "i int, a string, c string")
    assert [r[0] for r in df.orderBy("i").select(T.parse_amount(F.col("a"), F.col("c"))).collect()] == [x for *_, x in cases]


def test_dates(spark):
    cases = {"03/02/2026": date(2026, 2, 3), "03/02/69": date(2069, 2, 3), "03/02/70": date(1970, 2, 3), "2026-02-03": date(2026, 2, 3), "31/02/2026": None, " 03/02/2026": None, "x": None, "": None}
    assert each(spark, cases, T.parse_date) == list(cases.values())
    assert each(spark, ["", None, "x", "2026-02-03"], T.date_status) == ["blank", "blank", "bad", "ok"]


def test_variants(spark):
    pad = "x" * 200
    texts = [f"Estado de cuenta nacional {pad} ESTADO DE CUENTA INTERNACIONAL tail", "ESTADO DE CUENTA INTERNACIONAL", "none"]
    assert each(spark, texts, T.detect_variant) == ["NACIONAL", "INTERNACIONAL", None]
    assert each(spark, texts[:1], lambda c: T.strip_other_variant(c, F.lit("NACIONAL")))[0].endswith("x ")
    assert each(spark, texts[:1], lambda c: T.strip_other_variant(c, F.lit("INTERNACIONAL")))[0].endswith("INTERNACIONAL tail")
    long = "h" * 150 + "DETALLE" + "r" * 100
    assert each(spark, [long, "short"], lambda c: T.truncate_text(c, F.lit("NACIONAL"), 50)) == [long[150:200], "short"]


def test_chunks(spark):
    text = "\n".join("r" * 30 for _ in range(100))
    df = spark.createDataFrame([("a", text), ("b", "short"), ("c", None), ("d", ""), ("e", "y" * 250)], "doc_id string, text string")
    got = {}
    for r in T.chunk_text(df, size=100, overlap=10).orderBy("doc_id", "chunk_idx").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert got["b"] == ["short"] and got["d"] == [""] and "c" not in got
    assert all(len(x) <= 100 for x in got["a"]) and all(x.endswith("\n") for x in got["a"][:-1])
    assert got["e"] == ["y" * 100, "y" * 100, "y" * 70]
    whole = got["a"][0] + "".join(x[10:] for x in got["a"][1:])
    assert whole == text


def test_reply_parsing(spark):
    body = '{"transactions":[{"date":"03/02/2026","description":"LIDER","amount":"$ 1.000"},{"date":"x","description":" ","amount":"1"}],"metadata":{"currency":"CLP"},"confidence":0.5}'
    import json

    fenced = f"```json\n{body}\n```"
    bodies = [body, json.dumps({"choices": [{"message": {"content": fenced}}]}), json.dumps({"message": {"content": body}}), json.dumps({"content": [{"type": "text", "text": body}]}), None, "junk"]
    df = spark.createDataFrame([("d", i, b) for i, b in enumerate(bodies)], "doc_id string, chunk_idx int, body string")
    parsed = X.parse_replies(df)
    assert [r.reply is not None for r in parsed.orderBy("chunk_idx").collect()] == [True] * 4 + [False] * 2
    rows = X.typed_rows(X.extracted_rows(parsed)).collect()
    assert len(rows) == 4 and {(r.parsed_date, r.parsed_amount, r.row_error) for r in rows} == {(date(2026, 2, 3), D("1000.00"), None)}
    m = X.merge_chunks(parsed).first()
    assert (m.n_ok, m.n_failed, m.confidence, m.error, m.metadata.currency) == (4, 2, 0.5, None, "CLP")
    none = X.merge_chunks(parsed.where("reply is null")).first()
    assert none.error == "ExtractionError: all chunks failed"


def test_periods():
    assert Selection(date(2026, 7, 1), mode="ytd").window() == (date(2026, 1, 1), date(2026, 7, 31))
    assert Selection(date(2026, 7, 1), mode="all_time").window(date(2025, 2, 10)) == (date(2025, 2, 1), date(2026, 7, 31))
    assert Selection(date(2026, 1, 1), mode="3").window() == (date(2025, 11, 1), date(2026, 1, 31)) and Selection(date(2026, 1, 1), mode="3").label() == "Last 3 months"
    assert Selection(date(2026, 7, 1)).label() == "July 2026" and add_months(date(2026, 1, 1), -1) == date(2025, 12, 1)
    assert parse_mode("0") == "all_time" and parse_mode("0", "ytd") == "ytd" and parse_period("2026-07") == date(2026, 7, 1)
    for bad in (lambda: parse_period("2026-13"), lambda: parse_mode("5"), lambda: validate(limit=0), lambda: validate(range_=4)):
        with pytest.raises(ValueError):
            bad()


def test_summary_and_maps(spark):
    rows = [("CLP", date(2026, 7, 1), D("100.00")), ("CLP", date(2026, 6, 1), D("50.00")), ("USD", date(2026, 7, 2), D("31.00"))]
    tx = spark.createDataFrame(rows, "currency string, date date, amount decimal(15,2)")
    got = {r.currency: r for r in summary(tx, Selection(date(2026, 7, 1))).collect()}
    assert got["CLP"].change_pct == 100.0 and got["USD"].change_pct is None and got["USD"].daily_avg == D("1.00")
    assert totals_map(A.totals_by_currency(tx)).first().totals == {"CLP": D("150.00"), "USD": D("31.00")}


def postings(spark, amounts, days=30, card="c", installment=None):
    from datetime import timedelta

    rows = [(str(i), card, "s", date(2026, 1, 1) + timedelta(days=i * days), D(a), "CLP", "m", installment) for i, a in enumerate(amounts)]
    return spark.createDataFrame(rows, "id string, card_id string, statement_id string, date date, amount decimal(15,2), currency string, merchant_id string, installment_number int")


def statements(tx):
    return tx.groupBy(F.col("statement_id").alias("id"), F.col("card_id").alias("credit_card_id")).agg(F.max("date").alias("period_end"))


def test_detector(spark):
    five = postings(spark, ["10.00"] * 5, 20)
    r = R.detect(five, statements(five)).collect()
    assert [(x.n, x.confidence, x.period_days, x.period_label) for x in r] == [(5, 1.0, 20, "monthly")]
    out = postings(spark, ["10.00", "10.25", "10.50", "100.00"], 20)
    r = R.detect(out, statements(out)).first()
    assert r.n == 3 and str(r.median) == "10.375" and r.confidence == 0.5711
    for rows in (postings(spark, ["10.00"] * 2, 20), postings(spark, ["10.00", "13.00", "16.90"], 20), postings(spark, ["10.00"] * 4, 0), postings(spark, ["10.00"] * 4, 20, installment=1), postings(spark, ["-10.00"] * 4, 20)):
        assert R.detect(rows, statements(rows)).count() == 0


def test_rules_are_refreshed(spark):
    tx = postings(spark, ["10.00"] * 4, 20)
    found = R.detect(tx, statements(tx))
    once = R.upsert_rules(spark.createDataFrame([], model.RULES), found, tx, statements(tx))
    linked = R.backfill_rule_id(tx, once, found, statements(tx))
    assert {r.recurring_rule_id for r in linked.collect()} == {once.first().id}
    twice = R.upsert_rules(once, found, linked, statements(tx))
    assert once.count() == twice.count() == 1 and twice.first().id == once.first().id and once.first().occurrences == twice.first().occurrences == 4
    # postings of older statements and of other cards stay as they are
    more = tx.unionByName(tx.withColumn("id", F.concat(F.lit("o"), "id")).withColumn("statement_id", F.lit("old")).withColumn("date", F.date_sub("date", 200)))
    more = more.unionByName(tx.withColumn("id", F.concat(F.lit("d"), "id")).withColumn("card_id", F.lit("d")).withColumn("statement_id", F.lit("d")).limit(2))
    got = {r.id: r.recurring_rule_id for r in R.backfill_rule_id(more, once, R.detect(more, statements(more)), statements(more)).collect()}
    assert {i for i, r in got.items() if r} == {"0", "1", "2", "3"}


def test_rules_in_period_by_magnitude(spark):
    import random

    r = random.Random(1)
    amounts = [D(r.choice([1, 5, 20, 1000])) * D(r.randrange(70, 140)) / 100 for _ in range(60)] + [D("-5.00"), D("0.00"), D("85.00"), D("115.00")]
    tx = spark.createDataFrame([(f"m{i}", "CLP", date(2026, 1, 5), a.quantize(D("0.01"))) for i, a in enumerate(amounts)], "merchant_id string, currency string, date date, amount decimal(15,2)")
    rules = [(f"{i}-{k}", f"m{i}", 30, "monthly", D(low), D(high), "CLP", True, 1.0, date(2026, 1, 1), 3) for i in range(len(amounts)) for k, (low, high) in enumerate([("4.00", "6.00"), ("100.00", "100.00"), ("-6.00", "-4.00")])]
    got = {x.merchant_id for x in R.recurring_in_period(tx, spark.createDataFrame(rules, model.RULES), date(2026, 1, 1)).collect()}
    bounds = [(D("3.40"), D("6.90")), (D("85"), D("115")), (D("-5.10"), D("-4.60"))]
    assert got == {f"m{i}" for i, a in enumerate(amounts) if any(x <= a.quantize(D("0.01")) <= y for x, y in bounds)} and 10 < len(got) < len(amounts)


def test_folding(spark):
    cases = {"ŠKODA": "SKODA", "oﬃce": "office", "ＦＵＬＬ１": "FULL1", "cafe\u0301": "cafe", "ﬁn Ĳ": "fin IJ", "ñandú ẞ жё": "nandu ẞ жё", "ĳs": "ijs"}
    assert each(spark, cases, T.fold_accents) == list(cases.values())


def replay_plain(tx, ends):
    """Rules and links of a ledger whose statements are detected one after the other."""
    from datetime import timedelta
    from statistics import median

    rules, link, there = {}, {}, []
    for s in sorted(ends, key=lambda s: (ends[s], s)):
        there += [r for r in tx if r[2] == s]
        card = next(r[1] for r in tx if r[2] == s)
        groups = {}
        for r in there:
            if r[1] == card and r[3] >= ends[s] - timedelta(days=90) and r[7] is None and r[6] is not None:
                groups.setdefault((r[6], r[5]), []).append(r)
        for (merchant, currency), rows in groups.items():
            m = median(r[4] for r in rows)
            band = sorted((r for r in rows if m * D("0.85") <= r[4] <= m * D("1.15")), key=lambda r: r[3])
            if len(band) < 3:
                continue
            days = round(median((b[3] - a[3]).days for a, b in zip(band, band[1:], strict=False)))
            if days == 0:
                continue
            low, high = min(r[4] for r in band), max(r[4] for r in band)
            key = (merchant, low, high, currency, days)
            n = rules[key][0] + sum(r[2] == s and link.get(r[0]) != key for r in band) if key in rules else len(band)
            rules[key] = (n, band[-1][3], round(min(1.0, n / 5) * max(0.0, 1 - float((high - low) / m)), 4))
            link |= {r[0]: key for r in tx if r[2] == s and (r[6], r[5]) == (merchant, currency) and low <= r[4] <= high}
    return rules, link


def test_replay(spark):
    import random
    from datetime import timedelta

    r, rows = random.Random(4), []
    for i in range(400):
        day = date(2026, 1, 1) + timedelta(days=r.randrange(240))
        card = r.choice("ab")
        rows.append((str(i), card, f"{card}{day:%m}", day, D(r.choice(["10.00", "10.00", "10.50", "40.00", "-3.00"])), r.choice(["CLP", "USD"]), r.choice(["m", "n", None]), r.choice([None, None, None, 1])))
    tx = spark.createDataFrame(rows, "id string, card_id string, statement_id string, date date, amount decimal(15,2), currency string, merchant_id string, installment_number int")
    ends = {}
    for x in rows:
        ends[x[2]] = max(ends.get(x[2], x[3]), x[3])
    want, links = replay_plain(rows, ends)
    rules, linked = R.replay(tx, statements(tx), spark.createDataFrame([], model.RULES))
    rules, linked = spark.createDataFrame(rules.collect(), rules.schema), spark.createDataFrame(linked.collect(), linked.schema)
    key = {x.id: (x.merchant_id, x.amount_min, x.amount_max, x.currency, x.period_days) for x in rules.collect()}
    assert {key[x.id]: (x.occurrences, x.last_seen_date, x.confidence) for x in rules.collect()} == want and len(want) > 10
    assert {x.id: key[x.recurring_rule_id] for x in linked.where("recurring_rule_id is not null").collect()} == links and linked.count() == len(rows)
    again, still = R.replay(linked, statements(tx), rules)
    assert {x.id: x.occurrences for x in again.collect()} == {x.id: x.occurrences for x in rules.collect()}
    assert {(x.id, x.recurring_rule_id) for x in still.collect()} == {(x.id, x.recurring_rule_id) for x in linked.collect()}
    # the last statements arrive later
    late = F.col("period_end") >= F.lit(date(2026, 6, 1))
    early = tx.join(statements(tx).where(~late).select(F.col("id").alias("statement_id")), "statement_id")
    some, part = R.replay(early, statements(tx).where(~late), spark.createDataFrame([], model.RULES))
    both = part.unionByName(tx.join(early.select("id"), "id", "left_anti").withColumn("recurring_rule_id", F.lit(None).cast("string")))
    then = R.replay(both, statements(tx), some, statements(tx).where(late))
    assert {key[x.id]: x.occurrences for x in then[0].collect()} == {k: v[0] for k, v in want.items()}
    assert {x.id: key[x.recurring_rule_id] for x in then[1].where("recurring_rule_id is not null").collect()} == links


def test_merchants_resolve_once(spark):
    cats = model.seed_categories(spark)
    tx = spark.createDataFrame([("1", "LIDER COM 3"), ("2", "lider"), ("3", "NETFLIX SPA"), ("4", " ")], "id string, description string")
    aliases = spark.createDataFrame([], "id string, merchant_id string, alias_text string, normalized string, source string, confidence double")
    merchants = spark.createDataFrame([], "id string, name string, default_category_id string, is_active boolean")
    out, a1, m1 = C.resolve_merchants(tx, aliases, merchants, cats)
    by = {r.id: r.merchant_id for r in out.collect()}
    assert by["1"] == by["2"] is not None and by["4"] is None and m1.count() == 2
    _, a2, m2 = C.resolve_merchants(tx, a1, m1, cats)
    assert (a2.count(), m2.count()) == (a1.count(), m1.count()) == (2, 2)


def test_edits(spark):
    cats = model.seed_categories(spark)
    tx = spark.createDataFrame([(str(i), "1", "old", False) for i in range(4)], "id string, category_id string, category string, low_confidence boolean")
    edits = spark.createDataFrame([("0", "set", "2", None), ("1", "clear", None, None), ("2", "text", None, "mine"), ("3", "set", "99", None), ("x", "clear", None, None)], "id string, action string, category_id string, label string")
    after, rejected = M.apply_category_edits(tx, edits, cats)
    assert sorted(tuple(r) for r in after.select("id", "category_id", "category", "low_confidence").collect()) == [("0", "2", "Groceries", False), ("1", None, None, True), ("2", None, "mine", True), ("3", "1", "old", False)]
    assert {r.id: r.reason for r in rejected.collect()} == {"3": "unknown category", "x": "unknown transaction"}
    c, t, bad = M.rename_categories(cats, tx, spark.createDataFrame([("1", "Eating"), ("2", "TRAVEL")], "id string, name string"))
    assert {r.category for r in t.collect()} == {"Eating"} and [r.id for r in bad.collect()] == ["2"] and c.where("name = 'Groceries'").count() == 1


def test_guarded_upsert(spark):
    target = spark.createDataFrame([("a", 1, "user"), ("b", 2, "demo")], "id string, v int, origin string")
    batch = spark.createDataFrame([("b", 3), ("c", 4), ("a", 9)], "id string, v int")
    _, conflicts = M.guarded_upsert(target, batch, "id", "origin", "demo")
    assert [r.id for r in conflicts.collect()] == ["a"]
    once, none = M.guarded_upsert(target, batch.where("id <> 'a'"), "id", "origin", "demo")
    assert none.count() == 0 and sorted(tuple(r) for r in once.collect()) == [("a", 1, "user"), ("b", 3, "demo"), ("c", 4, "demo")]


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"text")
    got = {r.path[-5:]: r.rejected_reason for r in model.scan_statement_files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": None, "b.pdf": "not a PDF"}


def test_failed_statement_keeps_no_row(spark, tmp_path):
    rows = spark.createDataFrame([("s", date(2026, 1, 1), None), ("s", date(2026, 1, 2), "bad"), ("t", date(2026, 1, 3), None)], "statement_id string, date date, row_error string")
    model.write_transactions(rows, str(tmp_path / "tx"), str(tmp_path / "failed"))
    assert [r.statement_id for r in spark.read.parquet(str(tmp_path / "tx")).collect()] == ["t"]
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "failed")).collect()] == [("s", "bad")]


def test_stream_ingests_each_statement_once(spark, tmp_path):
    from tallyspark.streaming.statements import current_rules, ingest, stream_statements

    source, at = str(tmp_path / "in"), [str(tmp_path / n) for n in ("ledger", "rules", "links", "log", "checkpoint")]
    rows = postings(spark, ["10.00"] * 4, 20).withColumn("file_hash", F.lit("h")).withColumn("period_end", F.lit(date(2026, 4, 1)))
    twice = rows.unionByName(rows.withColumn("statement_id", F.lit("t")).withColumn("id", F.concat(F.lit("t"), "id")))

    def arrive(df):
        df.write.mode("append").parquet(source)
        ingest(stream_statements(spark, source), *at).awaitTermination(120)
        return [spark.read.parquet(p).collect() for p in at[:4]]

    for df in (twice, rows):
        ledger, _, links, log = arrive(df)
        assert {r.id for r in ledger} == {r.id for r in links} == set("0123") and len(ledger) == len(links) == 4
        assert [(r.occurrences, r.period_days) for r in current_rules(spark, at[1]).collect()] == [(4, 20)]
    # a later statement of the card adds one occurrence, an older one that comes late sees the newer postings
    step = rows.where("id = '3'")
    later = step.select(*[F.lit(x).alias(c) if c in ("id", "statement_id", "file_hash") else F.date_add(c, 20).alias(c) if c in ("date", "period_end") else F.col(c) for c, x in zip(rows.columns, ["z"] * 12, strict=False)])
    arrive(later)
    assert [r.occurrences for r in current_rules(spark, at[1]).collect()] == [5]
    late = step.select(*[F.lit("y").alias(c) if c in ("id", "statement_id", "file_hash") else F.date_sub(c, 80).alias(c) if c in ("date", "period_end") else F.col(c) for c in rows.columns])
    ledger, _, links, log = arrive(late)
    now = current_rules(spark, at[1]).first()
    assert now.occurrences == 6 and now.last_seen_date == date(2026, 3, 22) and {r.id for r in links} == {*"0123zy"} and len(ledger) == 6
    assert {r.status for r in log} == {"ok"}


def test_ingest(spark):
    import json

    from tallyspark.plans.ingest import ingest

    def body(rows, **kw):
        meta = {"card_number_masked": "1", "cardholder": "A", "currency": "CLP", "period_start": "", "period_end": "2026-02-28", "statement_date": "28/02/2026"}
        return json.dumps({"transactions": rows, "metadata": meta | kw.pop("meta", {}), "confidence": 0.9, "notes": "", **kw})

    def row(description="LIDER COM 3", amount="$ 1.000", currency="CLP", category="groceries ", day="03/02/2026", **kw):
        return {"date": day, "description": description, "amount": amount, "currency": currency, "category": category, **kw}

    rows = [row(), row(), row("Kiosko", category="Fun"), row("Bazar"), row("12"), row("Bazar 2", category=""), row(" ")]
    payloads = [
        ("a", 0, body(rows)), ("a", 1, body([row("lider com 3 ")])), ("a", 2, body([row("no", confidence=1)], confidence=2.0)), ("a", 3, body([row("long" * 200)])),
        ("b", 0, body([row(), row(currency="EUR", amount="$ 5")])), ("c", 0, body([], meta={"currency": "USD"})), ("d", 0, body([], meta={"period_end": "31/02/2026"})), ("e", 0, None), ("e", 1, body([], odd=1)),
        ("f", 0, body([row(installment_value="x", installment_number=1)])), ("g", 0, body([row(installment_number=0)])), ("h", 0, body([], meta={"currency": "CLP or USD", "card_number_masked": None})), ("i", 0, body(rows)), ("k", 0, body([])),
    ]
    p = spark.createDataFrame(payloads, "doc_id string, chunk_idx int, body string")
    files = spark.createDataFrame([(x, "b", x, "ha" if x == "i" else "h" + x, None if x == "k" else "NACIONAL") for x in "abcdefghijk"], "doc_id string, bank_id string, file_path string, file_hash string, variant string")
    none = [spark.createDataFrame([], s) for s in (model.STATEMENTS, "id string, bank_id string, card_number_masked string, cardholder string, currency string, is_active boolean")]
    aliases = spark.createDataFrame([("1", "m1", "Kiosko", "kiosko", "user", 1.0)], "id string, merchant_id string, alias_text string, normalized string, source string, confidence double")
    merchants = spark.createDataFrame([("m1", "kiosko", None, True)], "id string, name string, default_category_id string, is_active boolean")
    out = ingest(p, files, *none, aliases, merchants, model.seed_categories(spark), date(2026, 3, 5))
    assert {r.doc_id: r.error for r in out.rejected.collect()} == {
        "c": "IngestionError: metadata currency is not the variant's", "d": "DateError: period_end", "e": "ExtractionError: all chunks failed", "g": "ExtractionError: all chunks failed", "j": "ExtractionError: no chunks", "k": "IngestionError: no variant",
    }
    got = {r.file_hash: r for r in out.statements.collect()}
    assert {h: (r.status, r.error_message) for h, r in got.items()} == {"ha": ("completed", None), "hb": ("failed", "CurrencyError: EUR"), "hf": ("failed", "AmountError: x"), "hh": ("completed", None)}
    assert (got["ha"].period_start, got["ha"].period_end, got["ha"].statement_date) == (date(2026, 3, 5), date(2026, 2, 28), date(2026, 2, 28))
    assert {(r.card_number_masked, r.cardholder, r.currency) for r in out.cards.collect()} == {("1", "A", "CLP"), ("UNKNOWN-hh", "A", "CLP")}
    tx = {r.description: (r.category, r.low_confidence, r.merchant_id is None, str(r.amount)) for r in out.transactions.collect()}
    assert tx == {
        "LIDER COM 3": ("Groceries", False, False, "1000.00"), "Kiosko": ("Fun", True, False, "1000.00"), "Bazar": ("Groceries", True, False, "1000.00"), "12": ("Groceries", False, True, "1000.00"), "Bazar 2": ("Uncategorized", True, False, "1000.00"),
    }
    assert {r.name for r in out.merchants.collect()} == {"kiosko", "lider", "bazar"} and out.transactions.count() == 5
    again = ingest(p, files, *(spark.createDataFrame(t.collect(), t.schema) for t in (out.statements, out.cards, out.aliases, out.merchants)), model.seed_categories(spark), date(2026, 3, 5))
    assert again.transactions.count() == 0 and again.statements.count() == 4 and again.cards.count() == 2
