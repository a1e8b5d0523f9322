"""What is shown or handed to a model: descriptions, contexts, answers, records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderloom import lexicon as lx
from orderloom.functions import text as tx

# --- fixed values: wordings of answers and contexts -------------------------------------------
FAQ_RULES = ["- Answer only from FAQ_CONTEXT.", "- If the answer is not present, say the information was not found.", "- Do not infer missing store policy, price, promotion, or opening hours.", "- Keep the answer short and clear."]
CONSULTANT_RULES = ["- Recommend maximum 3 distinct items; mention each item only once with its sizes.", "- Only recommend items listed in RECOMMENDABLE_MENU_ITEMS.", "- If user preference is unclear, ask one short follow-up question.", "- Do not invent menu items, prices, promotions, or policies."]
UNKNOWN_ITEM = 'Dạ, bên em hiện chưa có món "%s" ạ. Anh/chị tham khảo cà phê, trà, freeze hoặc bánh bên em nhé, em gợi ý món hợp khẩu vị cho mình được không ạ?'
NO_MATCH = "Dạ, em chưa tìm thấy món này trong menu hiện tại. Anh/chị có thể nói rõ tên món hơn được không ạ?"
NOT_UNDERSTOOD = "Dạ, em chưa hiểu câu hỏi của anh/chị. Anh/chị thử hỏi lại nhé ạ 😊"
BUDGET_AND_EASY, BUDGET_ONLY = "Dạ, với tiêu chí giá mềm và dễ uống, ", "Dạ, với tiêu chí giá mềm, "
EASY_ONLY, ADVICE = "Dạ, nếu anh/chị muốn món dễ uống, ", "Dạ, em gợi ý như sau: "
NATURAL_STARTS = ["dạ", "với tiêu chí", "nếu anh", "nếu chị"]
POLITE = {"vi": ["nhé", "ạ", "em nhé", "giúp anh nhé", "giúp mình với"], "en": ["please", "thanks", "for me please"]}
TYPOS = [("không", "ko"), ("mình", "mik"), ("quán", "quan"), ("được", "dc"), ("wifi", "wf"), ("cà phê", "cafe"), ("mật khẩu", "pass")]
ORDER_STEPS = {
    "ask_item": "ASK_ITEM — hỏi khách muốn món nào trong CANDIDATE_ITEMS.",
    "ask_size": "ASK_SIZE — liệt kê các size kèm giá trong AVAILABLE_SIZES và hỏi khách chọn size nào.",
    "size_unavailable": "SIZE_UNAVAILABLE — báo size khách chọn không có, mời chọn size trong AVAILABLE_SIZES.",
    "confirm": "CONFIRM — nhắc lại số lượng, tên món, size, giá mỗi ly và xin khách xác nhận.",
}
ORDER_RULES = ["- Follow NEXT_ACTION exactly; ask only one question.", "- Never pick a size for the customer.", "- Do not confirm the order as completed.", "- Do not calculate total price.", "- Do not invent item, size, price, topping, or discount."]
UNKNOWN_NAME, UNKNOWN_SIZE = "(chưa rõ)", "(khách chưa chọn)"
REMINDER = "À, món **%s** lúc nãy anh/chị xác nhận giúp em để em thêm vào đơn nhé?"
INTENT_LABELS = {"order": ("🛒", "Đặt hàng"), "consultant": ("💡", "Tư vấn"), "faq": ("❓", "Hỏi đáp"), "ignore": ("🔇", "Không rõ")}
OTHER_INTENT = "🤖"
SUMMARY_HEAD = "TÓM TẮT HỘI THOẠI TRƯỚC ĐÓ:"
NO_ADVICE = "Dạ, em chưa có đủ dữ liệu để tư vấn chính xác. Anh/chị cho em biết khẩu vị, ngân sách hoặc thời tiết hôm nay nhé ạ?"
ADVICE_HEAD = "Dạ, em gợi ý mình vài món nè:\n"
ADVICE_END = "\n\nAnh/chị ưng món nào để em lên đơn ạ? Hoặc cho em biết thêm khẩu vị (đậm vị, mát lạnh, giá mềm…) để em gợi ý sát hơn nhé."
FOUND_HEAD, FOUND_END = "Dạ, em tìm thấy:\n", "\n\nAnh/chị nói rõ khẩu vị để em gợi ý phù hợp hơn ạ."
NO_FACT = "Dạ, hiện tại em chưa tìm thấy thông tin này trong FAQ. Anh/chị vui lòng hỏi nhân viên tại quầy để được xác nhận chính xác ạ."
FACT_HEAD, FACT_END = "Dạ, theo dữ liệu hiện có:\n", "\n\nEm chỉ trả lời dựa trên dữ liệu có sẵn, không tự suy diễn thêm ạ."
SMALL_TALK = "Dạ em nghe ạ. Anh/chị muốn đặt món, hỏi thông tin quán, hay cần em gợi ý món phù hợp không ạ?"
SUBTOTAL, TOTAL = "Tạm tính", "Tổng cộng"
CHECKOUT_HEAD, CHECKOUT_END = "Dạ, em đọc lại đơn của mình ạ:\n", "\n\nAnh/chị xác nhận chốt đơn này giúp em nhé?"
CART_HEAD, CART_END = "\n\nĐơn hiện tại:\n", "\n\nAnh/chị cần gọi thêm gì nữa không ạ?"
FAQ_MAX, CONSULTANT_MAX, SUPPORTING_MAX, ADVISED_MAX = 5, 5, 3, 3


def size_list(variants: Column) -> Column:
    """S 49.000đ · M 59.000đ; a single variant shows its price alone. variants: array of size and price."""
    shown = F.transform(variants, lambda v: F.concat_ws(" ", v["size"], tx.vnd(v["price"])))
    return F.when(F.size(variants) == 1, tx.vnd(variants[0]["price"])).otherwise(F.array_join(shown, " · "))


def price_range(variants: Column) -> Column:
    """45.000–65.000đ, or one price; empty without variants."""
    prices = F.transform(variants, lambda v: v["price"])
    low, high = F.array_min(prices), F.array_max(prices)
    both = F.concat(F.regexp_replace(tx.vnd(low), "đ$", ""), F.lit("–"), tx.vnd(high))
    return F.when(F.size(variants) == 0, "").when(low == high, tx.vnd(low)).otherwise(both)


def variant_description(name: Column, size: Column, price: Column, description: Column) -> Column:
    """The description with the variant's size and price after the name."""
    head = F.concat(name, F.lit(" size "), size, F.lit(" ("), tx.vnd(price), F.lit(")"))
    rest = F.substring(description, F.length(name) + 1, F.length(description))
    return F.when(F.startswith(description, name), F.concat(head, rest)).otherwise(F.concat(head, F.lit(" — "), description))


def faq_context(texts: Column) -> Column:
    """Numbered sources and the rules for answering from them; empty without sources."""
    numbered = F.transform(F.slice(texts, 1, FAQ_MAX), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    lines = F.concat(tx.words_in(["FAQ_CONTEXT:"]), numbered, tx.words_in(["", "FAQ_RULES:", *FAQ_RULES]))
    return F.when(F.size(texts) == 0, "").otherwise(F.array_join(lines, "\n"))


def consultant_context(items: Column, supporting: Column) -> Column:
    """items: array of name, variants (size, price), category and note; supporting: array of texts."""
    def line(i: Column) -> Column:
        note = F.when(i["note"] != "", F.concat(F.lit(" | note: "), i["note"])).otherwise("")
        return F.concat(F.lit("- item: "), i["name"], F.lit(" | sizes: "), size_list(i["variants"]), F.lit(" | category: "), i["category"], note)

    offered = F.transform(F.filter(F.slice(items, 1, CONSULTANT_MAX), lambda i: F.size(i["variants"]) > 0), line)
    support = F.transform(F.slice(supporting, 1, SUPPORTING_MAX), lambda t: F.concat(F.lit("- "), t))
    return F.array_join(
        F.concat(tx.words_in(["RECOMMENDABLE_MENU_ITEMS:"]), offered, tx.words_in(["", "SUPPORTING_CONTEXT:"]), support, tx.words_in(["", "CONSULTANT_RULES:", *CONSULTANT_RULES])), "\n"
    )


def order_answer(action: Column, item: Column, size: Column, quantity: Column, price: Column, variants: Column, unknown: Column) -> Column:
    """The answer that an order's resolution alone decides."""
    several = F.size(variants) > 1
    asked = F.transform(variants, lambda v: F.concat(F.lit("• Size **"), v["size"], F.lit("** — "), tx.vnd(v["price"])))
    sized = F.when(several, F.concat(F.lit(" size "), size)).otherwise("")
    return (
        F.when((action == "no_match") & (F.size(unknown) > 0), F.format_string(UNKNOWN_ITEM, F.array_join(unknown, " ")))
        .when(action == "no_match", NO_MATCH)
        .when(action == "ask_size", F.concat(F.lit("Dạ, **"), item, F.lit("** bên em có các size:\n"), F.array_join(asked, "\n"), F.lit("\n\nAnh/chị dùng size nào ạ?")))
        .when(action == "size_unavailable", F.concat(F.lit("Dạ, **"), item, F.lit("** không có size "), size, F.lit(" ạ. Bên em có: "), size_list(variants), F.lit(". Anh/chị chọn size nào ạ?")))
        .when(
            action == "confirm",
            F.concat(F.lit("Dạ, em ghi nhận **"), quantity.cast("string"), F.lit(" "), item, sized, F.lit("** — "), tx.vnd(price), F.when(several, "/ly").otherwise(""), F.lit(". Anh/chị xác nhận giúp em nhé? 😊")),
        )
    )


def consultant_fallback(items: Column, context: Column) -> Column:
    """The advice that needs no model. items: array of name, variants (size, price) and description, in order of rank; context: the sources' text, null for none."""
    def line(i: Column) -> Column:
        note = tx.short_description(i["description"])
        return F.concat(F.lit("• **"), i["name"], F.lit("**"), F.when(note != "", F.concat(F.lit(" — "), note)).otherwise(""), F.lit("\n   "), size_list(i["variants"]))

    lines = F.transform(F.filter(F.slice(items, 1, ADVISED_MAX), lambda i: F.size(i["variants"]) > 0), line)
    advice = F.concat(F.lit(ADVICE_HEAD), F.array_join(lines, "\n"), F.lit(ADVICE_END))
    found = F.concat(F.lit(FOUND_HEAD), context, F.lit(FOUND_END))
    return F.when(F.coalesce(context, F.lit("")) == "", NO_ADVICE).when(F.coalesce(F.size(items), F.lit(0)) > 0, advice).otherwise(found)


def faq_fallback(text: Column) -> Column:
    """The best source's text as an answer; null or empty for none."""
    return F.when(F.coalesce(text, F.lit("")) == "", NO_FACT).otherwise(F.concat(F.lit(FACT_HEAD), text, F.lit(FACT_END)))


def fallback_answer(intent: Column, order: Column, items: Column, context: Column, best: Column) -> Column:
    """What each agent answers where its model gives nothing: order, consultant, faq, and small talk for the rest."""
    return F.when(intent == "order", order).when(intent == "consultant", consultant_fallback(items, context)).when(intent == "faq", faq_fallback(best)).otherwise(SMALL_TALK)


def cart_summary(lines: Column, label: str = SUBTOTAL) -> Column:
    """A cart's lines and their sum. lines: array of quantity, item, size (null or empty: none) and price, in order."""
    each = F.transform(lines, lambda x: F.concat(F.lit("• "), line_label(x["quantity"], x["item"], x["size"]), F.lit(" — "), tx.vnd(x["price"] * x["quantity"])))
    total = F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + x["price"] * x["quantity"])
    return F.concat(F.array_join(each, "\n"), F.lit(f"\n**{label}: "), tx.vnd(total), F.lit("**"))


def checkout_answer(lines: Column) -> Column:
    return F.concat(F.lit(CHECKOUT_HEAD), cart_summary(lines, TOTAL), F.lit(CHECKOUT_END))


def cart_updated(prefix: Column, lines: Column) -> Column:
    return F.concat(prefix, F.lit(CART_HEAD), cart_summary(lines), F.lit(CART_END))


def cached_answer(answer: Column, intent: Column, context: Column, key: Column) -> Column:
    """A cached answer with a lead-in for advice that names what was asked for."""
    has = lambda c, *words: tx.any_of(F.coalesce(c, F.lit("")), list(words))
    easy = has(context, "dễ uống", "easy")
    lead = (
        F.when(has(context, "giá mềm", "rẻ", "budget") & easy, BUDGET_AND_EASY)
        .when(has(context, "giá mềm", "rẻ", "budget"), BUDGET_ONLY)
        .when(has(context, "dễ uống"), EASY_ONLY)
        .when(has(key, "gợi ý"), ADVICE)
    )
    natural = F.exists(tx.words_in(NATURAL_STARTS), lambda s: F.startswith(F.lower(answer), s))
    plain = (intent != "consultant") | (tx.strip(answer) == "") | lead.isNull() | natural
    return F.when(plain, answer).otherwise(F.concat(lead, F.lower(F.substring(answer, 1, 1)), F.substring(answer, 2, F.length(answer))))


def label_in(answer: Column) -> Column:
    """The first intent that a model's answer names; null if none."""
    low = F.lower(tx.strip(answer))
    return F.coalesce(*[F.when(F.contains(low, F.lit(i)), F.lit(i)) for i in lx.INTENTS])


def prediction(raw: Column) -> Column:
    """A prediction's label: of a JSON object its action or intent, else the text itself."""
    return F.lower(tx.strip(F.coalesce(F.get_json_object(raw, "$.action"), F.get_json_object(raw, "$.intent"), raw)))


def response_answer(body: Column) -> Column:
    """The first of four fields of a JSON response that is not blank, else a stock answer."""
    fields = [F.nullif(tx.strip(F.get_json_object(body, f"$.{k}")), F.lit("")) for k in ("answer", "response", "message", "content")]
    return F.coalesce(*fields, F.lit(NOT_UNDERSTOOD))


def cache_kind(body: Column) -> Column:
    """exact or semantic where the response's metadata say that a cache answered, else empty."""
    at = lambda path: F.get_json_object(body, f"$.metadata.cache.{path}")
    semantic = F.when((at("semantic.hit") == "true") | at("cache_type").isNotNull(), F.coalesce(at("cache_type"), F.lit("semantic"))).otherwise("")
    return F.when(at("hit") == "true", F.when(at("exact.hit") == "true", "exact").otherwise(semantic)).otherwise("")


def typing_pace(word: Column, first: Column, long_word: int = 8) -> Column:
    """How a word is paced when it is shown as if typed."""
    return (
        F.when(first, "first_word").when(word.rlike("[.!?:—]$"), "punctuation").when(word.rlike("^[•*-]"), "bullet").when(F.length(word) > long_word, "long_word").otherwise("word")
    )


def chat_record(system: str, user: Column, assistant: Column) -> Column:
    """A training record of three messages, as compact JSON."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.to_json(F.struct(F.array(message("system", F.lit(system)), message("user", user), message("assistant", assistant)).alias("messages")))


def noisy(text: Column, key: Column, language: Column, typo: float = 0.08, polite: float = 0.25) -> Column:
    """The text with typos and politeness by coins that its key alone decides."""
    coin = lambda salt: F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string"))), 1, 8), 16, 10).cast("long") / (1 << 32)
    out = text
    for i, (word, wrong) in enumerate(TYPOS):
        changed = (coin("t") <= typo) & (F.length(text) >= 6) & (coin(f"t{i}") < 0.5)
        out = F.replace(out, F.lit(word), F.when(changed, F.lit(wrong)).otherwise(F.lit(word)))
    ending = lambda lang: F.element_at(tx.words_in(POLITE[lang]), (F.floor(coin("e") * len(POLITE[lang])) + 1).cast("int"))
    return F.concat_ws(" ", out, F.when(coin("p") <= polite, F.when(language == "vi", ending("vi")).otherwise(ending("en"))))


def new_id(prefix: str) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.replace(F.uuid(), F.lit("-")), 1, 16))


def order_context(action: Column, item: Column, quantity: Column, size: Column, price: Column, variants: Column, choices: Column, description: Column) -> Column:
    """The state of an order and the next step, for a model; empty where nothing matched. variants: array of size and price; choices: array of name and variants."""
    line = lambda head, value: F.concat(F.lit(f"- {head}: "), value)
    asked = F.concat(tx.words_in([f"- item: {UNKNOWN_NAME}", "CANDIDATE_ITEMS:"]), F.transform(choices, lambda c: F.concat(F.lit("- "), c["name"], F.lit(": "), price_range(c["variants"]))))
    sizes = F.transform(variants, lambda v: F.concat(F.lit("- "), v["size"], F.lit(": "), tx.vnd(v["price"])))
    told = F.when(F.size(variants) > 0, F.array(line("description", tx.short_description(description)))).otherwise(F.array().cast("array<string>"))
    known = F.concat(F.array(line("item", item), F.lit("AVAILABLE_SIZES:")), sizes, told)
    chosen = F.when(price.isNotNull(), F.array(F.concat(F.lit("- selected: "), F.coalesce(size, variants[0]["size"]), F.lit(" — "), tx.vnd(price), F.lit("/ly")))).otherwise(F.array().cast("array<string>"))
    step = F.coalesce(*[F.when(action == a, F.lit(f"NEXT_ACTION: {x}")) for a, x in ORDER_STEPS.items()])
    lines = F.concat(
        tx.words_in(["ORDER_STATE:"]), F.when(action == "ask_item", asked).otherwise(known),
        F.array(line("quantity", quantity.cast("string")), line("requested_size", F.coalesce(size, F.lit(UNKNOWN_SIZE)))), chosen, F.array(F.lit(""), step), tx.words_in(["", "ORDER_RULES:", *ORDER_RULES]),
    )
    return F.when(action == "no_match", "").otherwise(F.array_join(lines, "\n"))


def line_label(quantity: Column, item: Column, size: Column) -> Column:
    return F.concat(quantity.cast("string"), F.lit(" "), item, F.when(F.coalesce(size, F.lit("")) != "", F.concat(F.lit(" size "), size)).otherwise(""))


def pending_reminder(intent: Column, pending: Column, label: Column) -> Column:
    """What is added to an answer about something else while a line waits to be confirmed; null where nothing is."""
    return F.when(~intent.isin("order", "ignore") & (pending == "confirm_line"), F.format_string(REMINDER, label))


def footer(intent: Column, latency: Column, cache: Column, followup: Column, session: Column) -> Column:
    """Below an answer: intent, cache tier (null: no hit), the question as understood (null: no follow-up), milliseconds, session."""
    emoji = F.coalesce(*[F.when(intent == i, F.lit(e)) for i, (e, _) in INTENT_LABELS.items()], F.lit(OTHER_INTENT))
    label = F.coalesce(*[F.when(intent == i, F.lit(x)) for i, (_, x) in INTENT_LABELS.items()], intent)
    tier = F.concat(F.upper(F.substring(cache, 1, 1)), F.lower(F.substring(cache, 2, 99)))
    hit = F.when(cache.isNull(), "").otherwise(F.concat(F.lit(" · ⚡ "), F.when(cache == "", "Cache").otherwise(tier), F.lit(" hit")))
    asked = F.when(followup.isNull(), "").otherwise(F.concat(F.lit("  ·  ↪ *"), followup, F.lit("*")))
    return F.concat(F.lit("\n\n---\n"), emoji, F.lit(" **"), label, F.lit("**"), hit, asked, F.lit("  ·  `"), F.bround(latency).cast("long").cast("string"), F.lit(" ms`  ·  `"), session, F.lit("`"))


def model_request(system: Column, summary: Column, history: Column, context: Column, question: Column) -> Column:
    """Messages for a model: the system prompt with a summary, known roles that are not blank, and the question with its context. history: array of role and content."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    prompt = F.when(filled(summary), tx.strip(F.concat(F.coalesce(system, F.lit("")), F.lit(f"\n\n{SUMMARY_HEAD}\n"), summary))).otherwise(F.coalesce(system, F.lit("")))
    kept = F.filter(history, lambda m: m["role"].isin("user", "assistant", "system") & (tx.strip(m["content"]) != ""))
    kept = F.transform(kept, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    asked = F.when(filled(context), F.concat(F.lit("CONTEXT:\n"), context, F.lit("\n\nUSER QUESTION:\n"), question)).otherwise(question)
    first = F.when(prompt != "", F.array(message("system", prompt))).otherwise(F.slice(F.array(message("system", prompt)), 1, 0))
    return F.concat(first, kept, F.array(message("user", asked)))


def coerced(value: Column, valid: list[str], fallback: Column) -> Column:
    """A model's label where it is one of the valid ones, else the router's."""
    return F.when(value.isin(valid), value).otherwise(fallback)


def extraction_value(extraction: Column, key: str) -> Column:
    """A text field of an extraction in JSON, trimmed; empty where it is missing or no text."""
    v = F.try_parse_json(extraction)
    return F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) == "STRING", tx.strip(F.try_variant_get(v, f"$.{key}", "string"))).otherwise("")


def menu_embedding_input(name: Column, english: Column, category: Column, description: Column, price: Column, size: Column) -> Column:
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(F.concat_ws(" | ", part(name), part(english), part(category), part(description), F.concat(part(price), F.lit(" VND")), F.concat(F.lit("Size "), part(size))))


def faq_embedding_input(topic: Column, question: Column, answer: Column) -> Column:
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("Topic: "), part(topic), F.lit("\nQuestion: "), part(question), F.lit("\nAnswer: "), part(answer))
