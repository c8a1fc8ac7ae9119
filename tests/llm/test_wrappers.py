import json
import random
import time

from tidemark.llm import wrappers

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">a</a></li><li><a>b</a></li></ul></nav>
<header><h2>Site</h2></header><div class="cookie-notice">We use cookies</div><div class="ad">Buy {0}</div><article><header><h1>Head {0}</h1></header><p><b>First &amp; {0}<br>line<p>Second
  &nbsp; part</p><div class="share">Share this</div><form><input name=q>find</form></article><aside>More</aside><section class="comments"><p>Nice {0}</p></section><footer>&copy; x</footer>"""


def wrapper_of(pages):
    w = None
    for page in pages:
        one = wrappers.fold(wrappers.parse(page))
        w = wrappers.bounded(wrappers.join(w, one) if w else one)
    return w


def rule_of(pages):
    return json.loads(json.dumps(wrappers.rules(wrapper_of(pages))))


def test_article_only():
    rule = rule_of([PAGE.format(i) for i in range(12)])
    assert wrappers.extract(PAGE.format(99), rule) == "Head 99\nFirst & 99\nline\nSecond part"
    assert wrappers.extract(None, rule) == "" == wrappers.extract("", rule)


def test_only_the_wrapper_tells_boilerplate():
    """No tag and no name tells article from the rest: slots and constants do."""
    rng = random.Random(1)
    words = lambda n: " ".join("".join(rng.choices("abcdefghijklm", k=5)) for _ in range(n))
    menu = "".join(f"<p>{words(30)}</p>" for _ in range(5))
    page = "<body><div>" + menu + "</div><div><p>Posted in the usual place</p><p>{0}</p><p>{1}</p><h5>Read on</h5></div><div><p>" + words(40) + "</p></div></body>"
    articles = [(words(20), words(15)) for _ in range(6)]
    pages = [page.format(*a) for a in articles]
    for n in (2, 6):
        rule = rule_of(pages[:n])
        assert [wrappers.extract(p, rule) for p in pages[:n]] == ["\n".join(a) for a in articles[:n]]
    alone = [wrappers.extract(p, None) for p in pages]
    assert all("Read on" in t or menu[3:40] in t for t in alone)  # a page by itself does not know


def test_pages_that_share_most_of_an_article_keep_it():
    pages = [f"<article><h1>Same head</h1><p>{'same words here ' * 20}</p><p>only this differs: {i}</p></article>" for i in range(5)]
    rule = rule_of(pages)
    assert rule["constants"] == {} and wrappers.extract(pages[3], rule) == "\n".join(["Same head", ("same words here " * 20).strip(), "only this differs: 3"])


def test_wrappers_do_not_depend_on_how_many_pages_there_are():
    pages = [PAGE.format(f"{i} and more of it") for i in range(40)]
    for n in (1, 2, 7, 8, 9, 40):
        rule = rule_of(pages[:n])
        assert wrappers.extract(pages[0], rule) == wrappers.extract(pages[0], rule_of(pages))


def test_alignment_makes_optional_and_repeated():
    a, b = (wrappers.fold(wrappers.parse(x)) for x in ("<ul><li>1</li><li>2</li></ul><p>x</p>", "<ul><li>3</li></ul><h1>y</h1><p>x</p>"))
    w = wrappers.join(a, b)
    assert wrappers.expression(w) == "(<ul> (<li> #TEXT </>)+ </>) (<h1> 'y' </>)? (<p> 'x' </>)"


def test_groups_of_several_kinds_repeat():
    pages = ["<dl>" + "".join(f"<dt>t{i}</dt><dd>d{i}{n}</dd>" for i in range(n)) + "</dl><h2>a</h2><p>b</p>" for n in (3, 1, 6)]
    w = wrapper_of(pages)
    assert wrappers.expression(w) == "(<dl> ((<dt> 't0' #TEXT </>) (<dd> #TEXT </>))+ </>) (<h2> 'a' </>) (<p> 'b' </>)"
    longer = wrapper_of([*pages, "<dl>" + "<dt>x</dt><dd>y</dd>" * 500 + "</dl><h2>a</h2><p>b</p>"])
    assert len(json.dumps(longer)) < 2 * len(json.dumps(w))
    inside = ["<body><div>" + "".join(f"<h2>Head {i}{n}</h2><p>text {i} of {n} goes on</p>" for i in range(n)) + "</div></body>" for n in (2, 4)]
    assert wrappers.extract(inside[0], rule_of(inside)) == "Head 02\ntext 0 of 2 goes on\nHead 12\ntext 1 of 2 goes on"


def test_very_deep_pages():
    for n in (3_000, 100_000):
        for tag in ("div", "ul", "section"):
            page = f"<article><p>before</p>{f'<{tag}>' * n}<p>inside</p><nav>menu</nav>{f'</{tag}>' * n}<p>after</p></article>"
            began = time.time()
            rule = rule_of([page, page.replace("inside", "within")])
            assert wrappers.extract(page, rule) == "before\ninside\nafter" == wrappers.extract(page, None)
            assert time.time() - began < 20
    assert wrappers.extract("<b>" * 50_000 + "x" + "</div>" * 50_000, None) == "x"


def test_very_long_pages_and_hostile_markup():
    page = "<article>" + "".join(f"<p>{i}</p><h3>{i}</h3>" if i % 3 else f"<div class=c{i}>{i}</div>" for i in range(30_000)) + "</article>"
    text = wrappers.extract(page, rule_of([page, "<article><p>x</p></article>"]))
    assert text.count("\n") == 49_999
    assert wrappers.extract("<p>a" + "<x " * 2000 + '"' * 999, None).startswith("a")


def test_random_names_do_not_make_wrappers_grow():
    rng = random.Random(2)
    name = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    page = lambda i: "<body><article>" + "".join(f'<div id="{name()}"><p>part {i} {j}</p></div>' for j in range(20)) + "</article></body>"
    pages = [page(i) for i in range(200)]
    few, many = wrapper_of(pages[:50]), wrapper_of(pages)
    assert len(json.dumps(many)) < 1.5 * len(json.dumps(few))
    rule = json.loads(json.dumps(wrappers.rules(many)))
    assert all(wrappers.extract(p, rule).count("part") == 20 for p in pages)
    wide = [f'<body><div id="{name()}">' + "".join(f'<p class="{name()}">{j}</p><i>x</i>' for j in range(300)) + "</div></body>" for _ in range(120)]
    assert len(json.dumps(wrapper_of(wide))) < 100 * wrappers.NODES


def test_alignments_are_common_subsequences():
    rng = random.Random(3)
    for _ in range(200):
        left, right = ([rng.choice("abcdef") for _ in range(rng.randrange(9))] for _ in range(2))
        pairs = wrappers.aligned(left, right)
        assert [i for i, _ in pairs if i is not None] == list(range(len(left))) and [j for _, j in pairs if j is not None] == list(range(len(right)))
        both = [(i, j) for i, j in pairs if i is not None and j is not None]
        assert all(left[i] == right[j] for i, j in both)
        best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(both) == best[-1][-1]
    long = [f"k{i}" for i in range(3000)]
    moved = [k for k in long if not k.endswith("7")]
    assert len(wrappers.common(long, moved[::-1] + moved)) == 0 and len(wrappers.common(long, moved)) == len(moved)


def test_rows(spark):
    rows = [(1, "http://a.example/1", PAGE.format(1)), (2, None, None), (3, "no url", "<p>loose &lt;text&gt; <!-- x"), (3, "http://b.example/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.url): r.text for r in wrappers.main_text(df).collect()}
    assert got[1, "http://a.example/1"].startswith("Head 1\nFirst & 1") and got[2, None] == "" and got[3, "no url"].startswith("loose <text>")
    assert wrappers.main_text(df.limit(0)).count() == 0


def test_raw_elements_after_letters_that_grow_in_lower_case():
    for k in (1, 3, 40):
        page = "<article><p>" + "\u0130" * k + "</p><SCRIPT>var a = 1</Script><p>First text</p><button>x</button><p>Second text</p></article>"
        assert wrappers.extract(page, None) == "\u0130" * k + "\nFirst text\nSecond text"
