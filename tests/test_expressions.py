"""Small cases for the column expressions."""

from pyspark.sql import Row, functions as F

from jobloom.functions import enrich, markup, origin, places, seniority, tags, text as tx, times, urls

C = F.col


def one(spark, expr, **values):
    row = spark.createDataFrame([Row(**values)]) if values else spark.range(1)
    return row.select(expr.alias("v")).first()["v"]


def lit(spark, fn, *args):
    return one(spark, fn(*[F.lit(a) for a in args]))


def test_canonical_link_drops_noise(spark):
    link = lambda u: lit(spark, urls.canonical_apply_url, u)
    assert link("http://WWW.Nordlicht-Werke.de/stellen/77?fbclid=q1&team=ops&utm_campaign=mai") == "https://nordlicht-werke.de/stellen/77?team=ops"
    assert link("harbour.example.org/open?z=9&m=two%20words&a=1") == "https://harbour.example.org/open?a=1&m=two+words&z=9"
    key = lambda u: lit(spark, urls.batch_apply_key, u)
    assert key("https://www.harbour.example.org/open/5?utm_medium=mail") == key("https://harbour.example.org/open/5")
    assert link(" \t") is None


def test_usable_links(spark):
    usable = lambda u: lit(spark, urls.apply_url_is_usable, u)
    assert not any(map(usable, ("https://api.smartrecruiters.com/v1/companies/dune/postings/4", "https://boards-api.greenhouse.io/v1/boards/dune", "file:///srv/jobs", "tel:12345", " ")))
    assert usable("https://dune.example.net/roles/4")


def test_board_ref(spark):
    ref = lambda u: tuple(lit(spark, urls.board_ref, u) or ())
    assert ref("https://boards.greenhouse.io/saltmarsh/jobs/90210?x=1") == ("greenhouse", "saltmarsh")
    assert ref("https://jobs.lever.co/quarry-nine/5d1f") == ("lever", "quarry-nine")
    assert ref("https://jobs.ashbyhq.com/tideline/apply") == ("ashby", "tideline")
    assert ref("https://saltmarsh.example.com/careers") == ()


def test_effort(spark):
    minutes = lambda u, s: lit(spark, urls.apply_effort, u, s)
    long_form = minutes("https://quarry.wd5.myworkdayjobs.com/de-DE/extern/job/7", "workday")
    short_form = minutes("https://boards.greenhouse.io/saltmarsh/jobs/90210", "greenhouse")
    assert short_form["minutes_high"] < long_form["minutes_low"]


def test_instants(spark):
    show = lambda v: one(spark, F.date_format(times.parse_instant(F.lit(v)), "yyyy-MM-dd HH:mm:ss"))
    assert show("1719835200") == show("1719835200000") == show("2024-07-01T12:00:00Z") == "2024-07-01 12:00:00"
    assert show("2024-07-01T14:00:00+02:00") == "2024-07-01 12:00:00" and show("2024-07-01") == "2024-07-01 00:00:00"
    assert show("Tue, 9 Jul 2024 08:15:30 GMT") == "2024-07-09 08:15:30"
    assert show("next week") is None and show("") is None


def classified(spark, title, description=None, level=None, emp=None):
    df = spark.createDataFrame([(title, description, level, emp)], "title string, description_text string, source_level string, employment_type string")
    return seniority.classify(df).first()


def test_seniority(spark):
    plain = classified(spark, "Backend Developer", "Keep our booking service fast.")
    assert (plain.career_stage, plain.junior_eligible, plain.years_required_min) == ("unknown", True, None)
    years = classified(spark, "Backend Developer", "We ask for 7+ years of experience with storage systems.")
    assert (years.junior_eligible, years.years_required_min) == (False, 7)
    torn = classified(spark, "Junior Data Engineer", "Minimum 6 years of experience required.")
    assert torn.career_stage == "junior" and not torn.junior_eligible and torn.seniority_signals.title_jd_contradiction
    intern = classified(spark, "Platform Intern", "Spend a summer with our tools team.")
    assert (intern.career_stage, intern.junior_eligible, intern.employment_type) == ("internship", True, "internship")
    for title, stage in (("Data Engineer, New Grad", "new_grad"), ("Junior QA Engineer", "junior"), ("Senior Site Reliability Engineer", "senior")):
        assert classified(spark, title).career_stage == stage
    assert not classified(spark, "Principal Engineer", "1-2 years").junior_eligible
    assert classified(spark, "Developer", "4-6 years of experience").years_required_min == 4
    assert classified(spark, "Studio Helper", level="Internship").career_stage == "internship"


def test_stage_rule():
    rule = seniority.stage_rule
    assert rule("junior") == rule("entry") == rule(None, True) == (True, None)
    assert rule("internship") == (False, "internship") and rule("new_grad") == (False, "new_grad") and rule("senior") == (False, "senior")


def test_level_exclusion(spark):
    hit = lambda s, y, e, level: one(spark, seniority.excluded_for_level(F.lit(s), F.lit(y).cast("int"), F.lit(e), F.lit(level)))
    assert hit("senior", None, False, "junior") and hit("unknown", 5, False, "junior")
    assert not hit("internship", 0, True, "junior") and not hit("senior", None, False, "senior")


def test_region(spark):
    friendly = lambda w, l, d: one(spark, enrich.region_friendly(F.lit(w), F.lit(l).cast("string"), F.lit(d).cast("string")))
    assert friendly("remote", "Karachi, Pakistan", "Any text") and friendly("remote", "Worldwide (async)", None)
    assert not friendly("onsite", "Karachi", "On our floor every day")


def test_skills_next_to_symbols(spark):
    found = lambda t: one(spark, enrich.extract_skills(F.lit(t)))
    assert found("(Rust/Docker), C++;") == found("docker rust c++")
    assert found("rusty dockers") == []
    assert one(spark, enrich.extract_skills(F.lit("Docker"), F.array(F.lit(" Rust ")))) == sorted({*found("docker"), "rust"})


def test_titles(spark):
    assert lit(spark, tx.fingerprint, " Night   Porter", "Hotel  Alba ", None) == "night porter|hotel alba|unknown"
    assert tuple(lit(spark, tx.split_company_role, "Alba: Night Porter")) == ("Alba", "Night Porter")
    assert tuple(lit(spark, tx.split_company_role, "Night Porter")) == ("Unknown", "Night Porter")
    assert lit(spark, tx.slugify, "Hotel Alba & Söhne") == "hotel-alba-sohne"
    assert lit(spark, tx.slugify, "Ω") == "company" and lit(spark, tx.title_key, "Night Porter - Remote") == lit(spark, tx.title_key, "Night Porter (Remote)") == "Night Porter"
    assert lit(spark, tx.software_role, "Platform Intern, Software", None) is True


def test_sources(spark):
    rank = lambda s: lit(spark, origin.source_rank, s)
    assert rank("greenhouse") < rank("remotive") < rank("themuse")


def test_tag_split(spark):
    words = lambda g: F.array(*[F.lit(x) for x in g])
    out = one(spark, tags.partition_tags(words(["docker", "java"]), words(["agile collaboration"]), words(["java"])))
    assert sorted(out.technologies) == ["docker", "java"] and out.skills == ["agile collaboration"]


def test_places(spark):
    at = lambda s: tuple(one(spark, places.postal_address(F.lit(s))) or ())
    assert at("Denver, CO") == ("US", "CO", "Denver") and at("Hamburg, Germany") == ("DE", None, "Hamburg")
    assert at("Anywhere") == ()
    assert one(spark, places.applicant_countries(F.lit("Remote (India or Germany)"))) == ["DE", "IN"]


def cleaned(spark, html, text=None):
    df = spark.createDataFrame([(html, text)], "description_html string, description_text string")
    r = markup.canonical_description(df).first()
    return r.description_html_clean, r.description_text_clean


def test_markup(spark):
    html, text = cleaned(spark, "<h1>Crew</h1><P class=lead>Sail <em>far</em></P><ol><li>Rope</li></ol>")
    assert html == "<h2>Crew</h2><P>Sail <em>far</em></P><ol><li>Rope</li></ol>" and text == "Crew Sail far Rope"
    assert cleaned(spark, "&lt;ul&gt;&lt;li&gt;Rope&lt;/li&gt;&lt;/ul&gt;") == ("<ul><li>Rope</li></ul>", "Rope")
    html, _ = cleaned(spark, None, "Read [the log](https://sea.example.org/log).\n\n* rope\n* sail\n\n1 < 2\nend")
    assert html == '<p>Read <a href="https://sea.example.org/log" rel="noopener noreferrer nofollow" target="_blank">the log</a>.</p><ul><li>rope</li><li>sail</li></ul><p>1 &lt; 2<br/>end</p>'
    html, text = cleaned(spark, "<div onclick='go()' data-k=1>Sail <a href='mailto:crew@sea.example.org' id=z>now</a> <a href='vbscript:x'>or not</a></div><form>no</form>")
    assert html == '<div>Sail <a href="mailto:crew@sea.example.org" rel="noopener noreferrer nofollow" target="_blank">now</a> or not</div>' and text == "Sail now or not"
    long_line = "<li>" + "the tide turns and turns " * 5 + "</li>"
    assert cleaned(spark, "<ul>" + long_line * 3 + "<li>x</li><li>x</li></ul>")[0].count("<li>") == 4
    assert cleaned(spark, None, None) == cleaned(spark, "", "  ") == cleaned(spark, "<p> </p>", None) == (None, None)


def test_lines_lose_only_the_blanks_at_their_ends(spark):
    assert cleaned(spark, None, " berth 10 \nberth 11\n  12 berths")[0] == "<p>berth 10<br/>berth 11<br/>12 berths</p>"
