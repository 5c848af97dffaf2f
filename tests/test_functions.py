"""Pure functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from groundspark.functions import contract, followup, routing, text, urls, vectors


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("given,wanted", [("\u00a0a  \u2013\tb\u200b ", "a - b"), ("\uf0b7", "-"), ("x\ue123y", "xy"), ("", "")])
def test_clean_line(spark, given, wanted):
    assert one(spark, given, text.clean_line) == wanted
    assert one(spark, wanted, text.clean_line) == wanted


def test_normal_forms(spark):
    assert one(spark, "Cafés & Más, 2nd!", text.normalise) == " caf s m s 2nd "
    assert one(spark, "..?", text.normalise).strip() == ""
    assert one(spark, "A-b c", text.fingerprint) == "a b c"
    assert one(spark, " Regular Plan (Growth) ", text.slug) == "regular-plan-growth"
    assert one(spark, "x " * 100, lambda c: text.preview(c, 20)) == "x x x x x x x x x..."
    assert [one(spark, v, text.mask_secret) for v in (None, "", "short", "abcdefghij")] == ["<not set>", "<not set>", "*****", "abcd**ghij"]


def test_furniture(spark):
    for line in ("Read more", "loading...", "+1 (555) 010-9999", "www.example.com", "COPYRIGHT 2024 Foo", "Skip to content"):
        assert one(spark, line, text.is_furniture), line
    assert not one(spark, "Read more about the exit load here", text.is_furniture)
    assert one(spark, "Great mix of investments Invest Now", text.without_call_to_action) == "Great mix of investments"
    assert one(spark, ["", "a", "", "", "b", ""], text.squeeze_blank_lines, "array<string>") == ["a", "", "b"]


def test_shapes_of_blocks(spark):
    assert one(spark, "a | b | c", text.is_table_block) and one(spark, "x 1.5 2\ny 3 4%", text.is_table_block)
    assert not one(spark, "x 1.5 2\nplain words only here\nmore plain words", text.is_table_block)
    for heading in ("1.2 Exit load", "IV. Risks", "Section 3 Fees", "Key facts:", "MINIMUM AMOUNT", "Short title"):
        assert one(spark, heading, text.looks_like_heading), heading
    for other in ("It ends here.", "two\nlines", "", "word " * 17, "a | b | c"):
        assert not one(spark, other, text.looks_like_heading), other
    assert one(spark, "One. Two? (Three) four! 5 six", text.split_sentences) == ["One.", "Two?", "(Three) four!", "5 six"]


def test_windows_lose_no_word_and_repeat_a_tables_header(spark):
    prose = " ".join(f"w{k}" for k in range(401))
    parts = one(spark, prose, text.window_split)
    assert [len(p.split()) for p in parts] == [160, 160, 81] and " ".join(parts) == prose
    table = " ".join(["Scheme", "NAV"] + [str(k) for k in range(400)])
    parts = one(spark, table, text.window_split)
    assert all(p.startswith("Scheme NAV 0 1") for p in parts) and all(len(p.split()) <= 160 for p in parts)
    assert one(spark, "", text.window_split) == [] and one(spark, "a b", lambda c: text.tail_overlap(c, 1)) == "b" and one(spark, "a", lambda c: text.tail_overlap(c, 1)) == ""


def test_allowed_urls(spark):
    for url in ("https://example.com/a", "HTTP://WWW.Example.org:8080/x", "https://a.b.example.com"):
        assert one(spark, url, urls.is_allowed_url), url
    for url in (None, "", "ftp://example.com", "https://badexample.com", "https://example.com.bad.net", "http://example.com:80@bad.net/", "not a url"):
        assert one(spark, url, urls.is_allowed_url) is False, url


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>").select(vectors.norm(F.col("a")).alias("n"), vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.cosine(F.col("a"), F.col("z")).alias("z"), vectors.unit(F.col("a")).alias("u")).first()
    assert row["n"] == 5 and abs(row["c"] - 0.96) < 1e-12 and row["z"] is None and row["u"] == [0.6, 0.8]
    mean = spark.createDataFrame([([[1.0, 1.0], [3.0, 5.0], [9.0, 9.0]], [1, 1, 0])], "v array<array<double>>, m array<int>").select(vectors.masked_mean(F.col("v"), F.col("m")).alias("y")).first()["y"]
    assert mean == [2.0, 3.0]


@pytest.mark.parametrize(
    "question,category",
    [("", "off_topic"), ("  ", "off_topic"), ("Should I buy it?", "advisory"), ("Is it worth buying now", "advisory"), ("Which one is suitable?", "advisory"), ("best performing fund", "performance"), ("compare returns of both", "performance"),
     ("Who won the match", "off_topic"), ("price of gold", "off_topic"), ("does the gold fund have an exit load?", "factual"), ("expense ratio?", "factual"), ("my PAN ABCDE1234F", "pii"), ("xyzzy", "factual"), ("Can I redeem it today?", "advisory")],
)
def test_classification(spark, question, category):
    assert one(spark, question, routing.classify) == category


LABELLED = {
    "factual": ["How large is the expense ratio of Acorn Multi Asset Fund?", "Which benchmark does Acorn Overnight Fund follow?", "What does the riskometer say about Acorn Infrastructure Fund?", "Has the rain any effect on units of a mutual scheme?", "qwfp arst", "What is the net asset value today?"],
    "advisory": ["Should  I put money into Acorn Gilt Fund", "should\nwe hold on?", "Could we purchase Acorn Overnight Fund", "Can i  sell it now", "Is that fund good for us?", "is it safe", "does it make sense to wait", "Any recommendation for ten years?", "what is your opinion about it", "help me pick", "Which should I take?", "is it a wise step"],
    "performance": ["Which scheme had the highest growth?", "Which funds performed best in 2021", "compare the nav of both", "did it outperform the index", "returns of Acorn Multi Asset Fund versus Acorn Overnight Fund", "What returns came in the past year", "How much has Acorn Infrastructure Fund grown since 2020?", "top performers please"],
    "pii": ["my pan is ABCDE1234F, should I buy", "Ring 9876543210 about the lock-in", "mail a.b@example.org the returns"],
    "off_topic": ["What was the score in the last Ashes match?", "When does the next flight to Goa leave?", "What time does the bus come", "next train home", "Who won Wimbledon?", "how high is the tower", "Who is the king of Spain", "bake a cake", "the price of gold"],
}


@pytest.mark.parametrize("category", LABELLED)
def test_labelled_questions(spark, category):
    asked = spark.createDataFrame([(q,) for q in LABELLED[category]], "q string")
    assert {r["q"]: r["c"] for r in asked.select("q", routing.classify(F.col("q")).alias("c")).collect()} == dict.fromkeys(LABELLED[category], category)


def test_labelled_topics(spark):
    named = "net asset value|cost ratio|the fees|a systematic investment plan|exit\nload|open-ended|who are the fund managers|turnover|customer care|merger|add a nominee".split("|")
    unnamed = "how do I invest|gilt|the fund|purchase|hello|tell me more".split("|")
    found = spark.createDataFrame([(q,) for q in named + unnamed], "q string").filter(routing.names_supported_topic(F.col("q"))).collect()
    assert sorted(r["q"] for r in found) == sorted(named)


def test_cleaned_blocks(spark):
    given = "Exit load  facts Read more\n\n\n\nMenu\nloading...\n1% within a year\nApply now"
    assert one(spark, given, text.clean_block) == "Exit load facts\n\n1% within a year"
    assert one(spark, "Menu\nSearch", text.clean_block) == "" and one(spark, "", text.clean_block) == ""


@pytest.mark.parametrize(
    "value,kind",
    [("ABCDE1234F", "pan"), ("xABCDE1234F", None), ("1234 5678 9012", "aadhaar"), ("12345678901234", None), ("a.b@c.org", "email"), ("+91 9876543210", "phone"), ("1.9876543210", None), ("folio no 123456789", "account"), ("account 123456789012", "aadhaar"), ("otp is 4455", "otp"), ("NAV 12.5", None)],
)
def test_personal_data_kinds_in_order(spark, value, kind):
    assert one(spark, value, routing.detect_pii) == kind
    assert (one(spark, value, routing.redact) == value) == (kind is None)


def test_topics_schemes_and_messages(spark):
    for q in ("lock in period", "TER please", "download the factsheet", "who is the fund manager", "80C benefit"):
        assert one(spark, q, routing.names_supported_topic), q
    assert not one(spark, "how do I invest in the fund", routing.names_supported_topic)
    assert one(spark, "Acorn gilt and multi-asset", routing.detect_schemes) == ["Acorn Multi Asset Fund", "Acorn Gilt Fund"]
    assert one(spark, "a gilt fund", routing.detect_scheme) is None and one(spark, "a gilt fund", routing.probable_scheme) == "Acorn Gilt Fund"
    assert "https://" in one(spark, "pii", routing.refusal) and one(spark, "factual", routing.refusal) is None
    assert "Acorn" in one(spark, "Acorn Overnight Fund", routing.clarification)


def test_contract_parts(spark):
    assert one(spark, "See e.g. this. Rs. 500 is it! https://www.example.com/a.b", contract.split_sentences) == ["See e.g. this.", "Rs. 500 is it!"]
    assert one(spark, "a https://example.com/x.pdf). b www.example.org,", contract.context_urls) == ["https://example.com/x.pdf", "www.example.org"]
    assert one(spark, "You should buy", contract.find_advice) == "You should" and one(spark, "It may rise", contract.find_advice) is None
    assert one(spark, "That information is not in the sources. Last updated from sources: not mentioned", contract.is_decline)
    pair = spark.createDataFrame([("2.25% of it, 5 years", "12.25% and 15 years")], "a string, c string")
    assert pair.select(contract.ungrounded_figures(F.col("a"), F.col("c")).alias("y")).first()["y"] == ["2.25", "5"]
    assert pair.select(contract.ungrounded_figures(F.col("a"), F.col("c"), parity=True).alias("y")).first()["y"] == []


def verified(spark, answer, context="see https://www.example.com/facts", source="https://www.example.com/src"):
    df = spark.createDataFrame([(answer, source, "2024-05-01", context)], "a string, s string, f string, c string")
    return df.select(contract.verify(F.col("a"), F.col("s"), F.col("f"), F.col("c")).alias("v")).first()["v"]


def test_verification_repairs_in_order(spark):
    good = verified(spark, "The load is 1%. https://www.example.com/facts")
    assert good["ok"] and good["problems"] == [] and good["citation"] == "https://www.example.com/facts" and good["answer"] == "The load is 1%. https://www.example.com/facts\nLast updated from sources: 2024-05-01"
    bad = verified(spark, "One. Two as of May. You should buy. Three. Four. Five. https://bad.net/x")
    assert bad["ok"] and bad["answer"].startswith("One. Three. Four. https://www.example.com/src\n")
    assert bad["problems"] == ["date not from the sources", "advice", "too many sentences", "link removed: https://bad.net/x"] and "source link added" in bad["repairs"]
    advice = verified(spark, "I recommend it. You should buy.")
    assert not advice["ok"] and contract.FALLBACK in advice["answer"]
    missing = verified(spark, "Plain fact.")
    assert missing["problems"] == [] and missing["repairs"] == ["source link added"]
    assert contract.FALLBACK in verified(spark, "")["answer"]


@pytest.mark.parametrize(
    "question,wanted",
    [("what about its fees?", "What is the fees for Acorn $1 Fund?"), ("ok, is there a lock-in?", "is there a lock-in for Acorn $1 Fund?"), ("minimum sip amount?", "What is the minimum sip amount for Acorn $1 Fund?"), ("the exit load", "What is the exit load for Acorn $1 Fund?"),
     ("Can I redeem it?", "Can I redeem Acorn $1 Fund?"), ("what is the nav of this fund", "what is the nav of Acorn $1 Fund?")],
)
def test_followups_are_rewritten(spark, question, wanted):
    row = one(spark, question, lambda c: followup.resolve(c, F.lit("Acorn $1 Fund")))
    assert (row["resolved"], row["changed"], row["scheme"]) == (wanted, True, "Acorn $1 Fund")


@pytest.mark.parametrize("question", ["", "ok thanks", "What is the expense ratio of Acorn Overnight Fund?", "exit load of Birchwood", "How do I download the statement of my whole account today please", "a b c d e f g h i j"])
def test_other_turns_pass_through(spark, question):
    row = one(spark, question, lambda c: followup.resolve(c, F.lit("Acorn Multi Asset Fund")))
    assert row["resolved"] == question and not row["changed"]
    assert not one(spark, "its fees", lambda c: followup.resolve(c, F.lit(None).cast("string")))["changed"]


@pytest.mark.parametrize("question", ["what about it?", "and that one?", "ok, and the same fund?", "it", "the"])
def test_turns_that_ask_for_nothing_pass_through(spark, question):
    row = one(spark, question, lambda c: followup.resolve(c, F.lit("Acorn Multi Asset Fund")))
    assert tuple(row) == (question, False, None, None)


def test_figures_in_basis_points_and_tails_without_an_end(spark):
    pair = spark.createDataFrame([("The load is 25 bps.", "it is 30 bps")], "a string, c string")
    assert pair.select(contract.ungrounded_figures(F.col("a"), F.col("c")).alias("y")).first()["y"] == ["25"]
    assert verified(spark, "One is as\nof May 2024. Two. Three. Four. Five")["answer"].startswith("Two. Three. Four. https://")


def test_routing_does_not_change_by_rewriting(spark):
    for q in ("its exit load?", "should I buy it?", "can I redeem it?"):
        row = one(spark, q, lambda c: followup.resolve(c, F.lit("Acorn Multi Asset Fund")))
        assert one(spark, q, routing.classify) == one(spark, row["resolved"], routing.classify)


def test_personal_data_is_found_as_by_all_patterns_in_turn(spark):
    import random

    rng = random.Random(4)
    bits = ["1", "23", "4567", " ", "-", "\n", "\t", "@", "a.b", "x.org", "ABCDE", "F", "acc no ", "folio", "OTP", "verification code", "+91", "XZ", ".", "9876543210", "٤٥٦٧", "é"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 9))) for _ in range(4000)]
    texts += ["acc 1-2-3-4-5-6-7-8-9", "acc 1 2 3 4 5 6 7 8 9", "my otp: 4455", "a@b.io", "ABCDE1234F", "1234 5678-9012", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    found = df.select("k", "t", routing.detect_pii(F.col("t")).alias("pii"), routing.redact(F.col("t")).alias("told"))
    wanted = [next((k for k, _ in routing.PII if r[k]), None) for r in df.orderBy("k").select(*[F.col("t").rlike(p).alias(k) for k, p in routing.PII]).collect()]
    rows = found.orderBy("k").collect()
    assert [r["pii"] for r in rows] == wanted and len(set(wanted)) == 7
    assert all(r["told"] == (r["t"] if r["pii"] is None else f"[withheld: {r['pii']}]") for r in rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[A-Z]{5}[0-9]{4}[A-Z]") == 2  # once for each column
