"""Golden rows for functions, operators and folds."""

import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from orderloom.functions import answers
from orderloom.functions import text as tx
from orderloom.operators import catalog, intents, metrics, retrieval
from orderloom.sources import files
from orderloom.streaming import sessions


def values(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


def test_text_functions(spark):
    assert values(spark, ["Anh muốn gọi cappuccino ít ngọt", "cho anh 2"], tx.clean_query) == ["cappuccino ít ngọt", "cho anh 2"]
    assert values(spark, ["Bạc xỉu", "Trà đào cam sả", "  Đá--Xay! "], tx.slug) == ["bac-xiu", "tra-dao-cam-sa", "da-xay"]
    assert values(spark, ["Trà X size M (59.000đ) — chua nhẹ, thanh mát. Phù hợp…"], tx.short_description) == ["chua nhẹ, thanh mát"]
    assert values(spark, ["49.000đ", "54000 VND", "size M, vat"], tx.spoken) == ["49k", "54k", "size mờ, thuế"]
    assert values(spark, ["  Có WIFI  không?! "], tx.cache_text) == ["có wifi không"]
    assert values(spark, ["ê", None], tx.nfc) == ["ê", None]
    assert values(spark, ["mật khẩu wifi", "!!", "cà phê sữa cho anh"], tx.search_terms) == [["khẩu", "wifi", "mật"], [" "], ["cà phê", "phê", "sữa", "cà"]]
    assert values(spark, ["xin {\"a\": 1} xong", "{\"a\"", "[1]"], tx.json_object) == ["{\"a\": 1}", None, None]
    assert values(spark, ["Xin chào anh, hi! Dạ em nghe ạ. Còn", "không"], tx.clauses) == [["Xin chào anh,", "Dạ em nghe ạ.", "Còn"], ["không"]]
    assert values(spark, ["35000"], lambda c: tx.vnd(c.cast("int"))) == ["35.000đ"]


def test_cosine(spark):
    rows = [([1.0, 0.0], [2.0, 0.0]), ([], []), ([1.0], [1.0, 2.0]), ([0.0], [1.0]), ([1.0, 1.0], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert [round(r.c, 4) for r in df.select(tx.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0, 0.0, 0.7071]


def test_router(spark):
    cases = {
        "Cho anh 1 bạc xỉu": "order", "Có thanh toán momo không?": "faq", "gợi ý món ngon": "consultant", "alo": "ignore", "xyz": "ignore", "có trà đào không": "order",
        "có bán phở bò không": "order", "có wifi không": "faq", "trà": "order", "": "ignore",
    }
    df = spark.createDataFrame(list(cases.items()), "text string, want string")
    assert {r.text: r.intent for r in intents.route(df).collect()} == cases
    assert intents.route(spark.createDataFrame([(None,)], "text string")).first().intent == "ignore"


def test_sizes_and_quantities(spark):
    texts = ["size S à thôi size L", "M", "vừa nhé", "vừa gọi xong", "size xl", "2 ly trà, à 3 ly", "mười ly", "ba ơi", "0", None, "ly lớn ạ"]
    assert values(spark, texts, intents.ordered_size) == ["L", "M", "M", None, "XL", None, None, None, None, None, "L"]
    assert values(spark, texts, intents.ordered_quantity) == [1, 1, 1, 1, 1, 3, 10, 1, 1, 1, 1]


MENU = [
    ("Trà vải", "S", 45000), ("Trà vải", "L", 65000), ("Trà bưởi mật ong", "M", 50000), ("Trà bưởi mật ong", "L", 60000), ("Bánh mì", "S", 30000), ("Bạc xỉu", "S", 35000), ("Bạc xỉu", "M", 45000),
]


def test_orders(spark):
    menu = spark.createDataFrame([(*m, True) for m in MENU], "name string, size string, price int, available boolean")
    cases = {
        "cho 2 trà": ("ask_item", None), "trà vải": ("ask_size", "Trà vải"), "cho 2 trà vải size L": ("confirm", "Trà vải"), "trà bưởi size s": ("size_unavailable", "Trà bưởi mật ong"),
        "phở bò": ("no_match", None), "bánh mì": ("confirm", "Bánh mì"), "cho em": ("no_match", None), "bạc xỉu size m": ("confirm", "Bạc xỉu"),
    }
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    rows = {r.text: r for r in intents.resolve_orders(df, menu).collect()}
    assert {t: (r.action, r["item"]) for t, r in rows.items()} == cases
    assert rows["cho 2 trà vải size L"].price == 65000 and rows["cho 2 trà vải size L"].quantity == 2
    assert rows["phở bò"].unknown_words == ["phở", "bò"] and rows["cho 2 trà"].choices == ["Trà bưởi mật ong", "Trà vải"]


def test_extraction(spark):
    rows = [("Quán có wifi không?", "faq"), ("gợi ý cà phê ít ngọt", "consultant"), ("what is cheap and sweet", "consultant"), ("cho anh 1 latte nhé", "order"), ("không cà phê, trời nóng", "consultant")]
    df = spark.createDataFrame(rows, "text string, intent string")
    got = {r.text: (r.cache_key, r.language) for r in intents.extract(df).collect()}
    assert got == {
        "Quán có wifi không?": ("mật khẩu wifi", "vi"), "gợi ý cà phê ít ngọt": ("gợi ý cà phê ít ngọt", "vi"), "what is cheap and sweet": ("recommend ngọt giá rẻ", "en"),
        "cho anh 1 latte nhé": ("1 latte", "vi"), "không cà phê, trời nóng": ("gợi ý không cà phê giải nhiệt", "vi"),
    }


def test_catalog(spark, tmp_path):
    path = tmp_path / "menu.csv"
    path.write_text('id,name_vi,name_en,price,size,category,ingredients,description,tags,available\nm2,Bạc xỉu,White,45000,M,coffee,sữa|đá,"Bạc xỉu size M (45.000đ) — béo, ""ngon"".",milk|iced,true\n'
                    'm1,Bạc xỉu,White,35000,S,coffee,sữa| cà phê |,"Bạc xỉu size S (35.000đ) — nhẹ.",iced|hot,false\n', encoding="utf-8")  # fmt: skip
    rows = files.read_csv(spark, str(path), files.MENU).withColumn("ord", F.monotonically_increasing_id()).withColumnRenamed("name_vi", "name")
    p = catalog.products(rows).first()
    assert (p.slug, p.status, p.description) == ("bac-xiu", "active", "Bạc xỉu — nhẹ.")
    assert p.tags == ["milk", "iced", "hot"] and p.ingredients == ["sữa", "đá", "cà phê"] and p.option_groups == ["sugar"]
    assert [(v.id, v.size, v.price) for v in p.variants] == [("m1", "S", 35000), ("m2", "M", 45000)]


def test_order_contexts(spark):
    v = [("M", 49000), ("L", 59000)]
    rows = [("confirm", "Latte", 2, "L", 59000, v, None), ("ask_size", "Latte", 1, None, None, v, None), ("ask_item", None, 1, None, None, None, [("Latte", v), ("Mocha", v[:1])]), ("no_match", None, 1, None, None, None, None)]
    df = spark.createDataFrame(rows, "action string, item string, quantity int, size string, price int, variants array<struct<size:string,price:int>>, choices array<struct<name:string,variants:array<struct<size:string,price:int>>>>")
    c = F.col
    got = [r.x for r in df.select(answers.order_context(c("action"), c("item"), c("quantity"), c("size"), c("price"), c("variants"), c("choices"), F.lit("Latte — mild, hot. Good.")).alias("x")).collect()]
    rules = "\n\nORDER_RULES:\n" + "\n".join(answers.ORDER_RULES)
    head = "ORDER_STATE:\n- item: Latte\nAVAILABLE_SIZES:\n- M: 49.000đ\n- L: 59.000đ\n- description: mild, hot\n"
    assert got[0] == head + "- quantity: 2\n- requested_size: L\n- selected: L — 59.000đ/ly\n\nNEXT_ACTION: " + answers.ORDER_STEPS["confirm"] + rules
    assert got[1] == head + f"- quantity: 1\n- requested_size: {answers.UNKNOWN_SIZE}\n\nNEXT_ACTION: " + answers.ORDER_STEPS["ask_size"] + rules
    assert got[2].startswith(f"ORDER_STATE:\n- item: {answers.UNKNOWN_NAME}\nCANDIDATE_ITEMS:\n- Latte: 49.000–59.000đ\n- Mocha: 49.000đ\n- quantity: 1\n") and got[3] == ""


def test_subjects_and_fields(spark):
    assert values(spark, ["Cho chị 1 trà #12", "mình muốn gọi", "bọn em đặt", "trà đào"], tx.subject_vi) == ["chị", "mình", "bọn em", ""]
    assert values(spark, ["My friend and I want tea", "can we", "I want", "tea"], tx.subject_en) == ["my friend and I", "we", "I", ""]
    assert values(spark, ['{"a": " x "}', '{"a": 5}', "{", None], lambda c: answers.extraction_value(c, "a")) == ["x", "", "", ""]


def test_datasets_are_counted_when_written(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab"[i % 2], None) for i in range(5)], "i int, k string, none string")
    assert sorted(map(tuple, files.write_dataset(df, f"{tmp_path}/d", ["k"], 5).collect())) == [("a", 3), ("b", 2)]
    with pytest.raises(ValueError):
        files.write_dataset(df, f"{tmp_path}/e", ["k"], 6)


def test_files(spark, tmp_path):
    src = tmp_path / "docs.jsonl"
    src.write_text('{"id": "a", "text": "x", "chunk_index": 1}\n\n{"id": "b", "entities": [{"name": "n"}]}\n')
    got = {r.id: r for r in files.read_chunks(spark, str(src)).collect()}
    assert got["a"].entities == [] and got["b"].entities[0].name == "n" and files.blank_lines(spark, str(src)) == 1
    out = str(tmp_path / "out")
    files.write_jsonl(spark.createDataFrame([(1, "đá", None)], "a int, b string, c string"), out)
    assert spark.read.text(out).first().value == '{"a":1,"b":"đá","c":null}'
    (tmp_path / "rows.json").write_text('[{"a": 1}, {"a": 2}]')
    assert files.read_json_array(spark, str(tmp_path / "rows.json"), "a int").count() == 2


def test_next_edges_over_many_parts(spark):
    chunks = spark.range(0, 500, 1, 7).select(F.col("id").alias("source_id"))
    assert {(r.source_id, r.target_id) for r in catalog.next_edges(chunks).collect()} == {(i, i + 1) for i in range(499)}


def test_rerank_cuts_before_the_threshold(spark):
    hits = spark.createDataFrame([(1, f"s{i}", "menu", "order", f"t{i}", 0.5) for i in range(8)], "query_id int, source_id string, source_type string, intent string, text string, score double")
    q = spark.createDataFrame([(1, "order", "cho 2 trà")], "query_id int, intent string, text string")
    scorer = lambda query, passage: F.when(query == "trà", F.substring(passage, 2, 1).cast("double") / 500).otherwise(9.0)
    assert sorted(r.source_id for r in retrieval.model_rerank(hits, q, scorer).collect()) == ["s5", "s6", "s7"]
    assert retrieval.model_rerank(hits, q).count() == 5


def test_quantiles(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "v double")
    assert metrics.nearest_rank(df, "v", 0.5).first().percentile == 3 and metrics.nearest_rank(df, "v", 0.95).first().percentile == 100
    import statistics

    for n in (2, 3, 10, 37):
        vs = [float(random.Random(n).randint(0, 99)) for _ in range(n)]
        got = metrics.exclusive_quantile(spark.createDataFrame([(v,) for v in vs], "v double"), "v", 0.9).first().quantile
        assert got == pytest.approx(statistics.quantiles(vs, n=10)[8])


def test_rate_limit_batch_and_stream(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), float(rng.randint(0, 300))) for _ in range(400)]
    want = []
    for c in "abc":
        kept = []
        for t in sorted(t for x, t in rows if x == c):
            kept = [k for k in kept if t - k <= 60]
            want.append((c, t, len(kept) < 5))
            if len(kept) < 5:
                kept.append(t)
    df = spark.createDataFrame(rows, "client string, seconds double")
    key = lambda r: (r[0], r[1], r[2])
    assert sorted(map(key, sessions.rate_limit(df, "client", "seconds", 5, 60).collect())) == sorted(want)
    df.where("seconds < 150").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    df.where("seconds >= 150").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 100).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = sessions.rate_limit_stream(stream, "client", "seconds", 5, 60).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(key, spark.sql("select client, seconds, allowed from limited").collect())) == sorted(want)


def test_exact_cache(spark):
    rng = random.Random(4)
    rows, t = [], 0.0
    for i in range(300):
        t += rng.randint(1, 40)
        rows.append(("c", i, t, rng.choice("abcdefg")))
    store, want = OrderedDict(), []
    for _, i, t, k in rows:
        live = k in store and store[k] > t
        want.append((i, live))
        if not live:
            store[k] = t + 100
        store.move_to_end(k)
        if len(store) > 4:
            store.popitem(last=False)
    df = spark.createDataFrame(rows, "cache string, n long, seconds double, key string")
    got = sessions.exact_cache(df, "cache", "n", "seconds", "key", ttl=100, size=4).collect()
    assert sorted((r.n, r.hit) for r in got) == want


def test_semantic_cache(spark):
    rows = [("c", 0, 0.0, "a", [1.0, 0.0]), ("c", 1, 1.0, "b", [0.99, 0.1]), ("c", 2, 2.0, "d", [0.0, 1.0]), ("c", 3, 200.0, "a", [1.0, 0.0]), ("c", 4, 201.0, "z", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "cache string, n long, seconds double, key string, e array<double>")
    got = {r.n: (r.hit, r.matched) for r in sessions.semantic_cache(df, "cache", "n", "seconds", "key", "e", 0.9, 100).collect()}
    assert got == {0: (False, None), 1: (True, "a"), 2: (False, None), 3: (False, None), 4: (False, None)}


def test_follow_ups(spark):
    said = ["gợi ý món ít ngọt", "lạnh", "hello", "còn trà thì sao?", "cho anh 1 bạc xỉu", "size l", "wifi"]
    df = intents.route(spark.createDataFrame([(1, i, t) for i, t in enumerate(said)], "session long, turn long, text string"))
    got = [(r.intent, r.reason, r.query) for r in sessions.follow_ups(df).orderBy("turn").collect()]
    assert got == [
        ("consultant", None, said[0]), ("consultant", "router_no_intent", "gợi ý món ít ngọt lạnh"), ("ignore", None, "hello"),
        ("consultant", "followup_marker", "gợi ý món ít ngọt lạnh còn trà thì sao?"), ("order", None, said[4]), ("order", "order_modifier_without_item", "cho anh 1 bạc xỉu size l"), ("faq", None, "wifi"),
    ]


def test_an_answer_to_an_order_question_completes_it(spark):
    rows = [(1, 0, "cho 2 trà", "order", False, "ask_item"), (1, 1, "trà vải", "order", False, "confirm"), (1, 2, "trà bưởi", "order", False, "confirm")]
    df = spark.createDataFrame(rows, "session long, turn long, text string, intent string, weak boolean, action string")
    assert [r.reason for r in sessions.follow_ups(df).orderBy("turn").collect()] == [None, "answer_to_order_question", None]


def test_dialogue():
    cart, line = sessions.Cart(), {"item": "Trà vải", "size": "L", "quantity": 2, "price": 65000}
    assert cart.hear("cho 2 trà vải") is None
    cart.after("order", "confirm", line)
    assert cart.hear("ok em") == "cart_updated" and cart.total() == 130000 and cart.pending[0] == "anything_else"
    assert cart.hear("bỏ đá") == "customization_unsupported"
    assert cart.hear("xem đơn") == "cart_updated"
    assert cart.hear("không") == "checkout_summary" and cart.hear("vâng ạ") == "order_submitted" and cart.submitted == [[line]]
    assert cart.hear("chốt đơn") == "checkout_empty_cart" and cart.hear("ok") == "acknowledge" and cart.hear("bỏ trà vải") == "remove_from_empty_cart"
    cart.after("order", "ask_size", None)
    assert cart.hear("không") == "question_dropped" and cart.pending is None
    cart.after("order", "confirm", line)
    assert cart.hear("chốt đơn") == "checkout_summary" and cart.hear("bỏ trà vải đi") == "line_removed"
    cart.after("order", "confirm", line)
    assert cart.hear("huỷ đơn") == "order_cancelled" and not cart.lines


def test_sessions_split_after_the_gap(spark):
    rows = [("u", 0), ("u", 1800), ("u", 3601), ("v", 0)]
    df = spark.createDataFrame(rows, "u string, s long").select("u", F.timestamp_seconds("s").alias("ts"))
    got = sorted((r.u, r.ts.timestamp(), r.session) for r in sessions.sessionize(df, "u", "ts").collect())
    assert [g[2] for g in got] == [0, 0, 1, 0]
    assert sorted((r.u, r.n) for r in sessions.session_windows(df, "u", "ts").collect()) == [("u", 1), ("u", 2), ("v", 1)]
