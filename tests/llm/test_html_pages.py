"""Pages written by hand, with the text that each of them holds."""

import pytest

from treeline.llm import html_blocks as H

A = "The river rose by three metres during the night, and two bridges had to be closed."
B = "By noon the water had reached the market, where traders carried their goods to higher ground."
C = "Nobody was hurt, the mayor said, but the damage will take months to repair."
T = "Flood closes two bridges"
NAV = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/s'>Sport</a></li></ul></nav>"
FOOT = "<footer>&copy; 2024 The Daily Example. All rights reserved.</footer>"


def page(body):
    return f"<!DOCTYPE html><html><head><title>{T}</title></head><body>{body}</body></html>"


P3 = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
WHOLE = [T, A, B, C]
PAGES = {
    "article": (f"{NAV}<article><h1>{T}</h1>{P3}</article>{FOOT}", WHOLE),
    "unknown class": (f"{NAV}<div class='txt'><h1>{T}</h1>{P3}</div>{FOOT}", WHOLE),
    "unknown id": (f"{NAV}<section id='qx7'><h1>{T}</h1>{P3}</section>{FOOT}", WHOLE),
    "story": (f"{NAV}<div class='story'><h1>{T}</h1><p>{A}</p><p>{B}</p></div>{FOOT}", [T, A, B]),
    "plain div": (f"{NAV}<div><h1>{T}</h1>{P3}</div>{FOOT}", WHOLE),
    "no container": (f"{NAV}<h1>{T}</h1>{P3}{FOOT}", WHOLE),
    "no menu": (f"<main><h1>{T}</h1>{P3}</main>{FOOT}", WHOLE),
    "no footer": (f"{NAV}<main><h1>{T}</h1>{P3}</main>", WHOLE),
    "nothing around": (f"<article><h1>{T}</h1>{P3}</article>", WHOLE),
    "form in article": (f"{NAV}<article><h1>{T}</h1><p>{A}</p><form><p>Subscribe to get it by mail every day.</p><input><button>Go</button></form><p>{B}</p></article>{FOOT}", [T, A, B]),
    "form with heading": (f"<main><h1>{T}</h1>{P3}<form class='signup'><h3>Newsletter</h3><p>Get our best stories.</p><button>Join</button></form></main>{FOOT}", WHOLE),
    "search form": (f"{NAV}<form class='search'><label>Search this site</label><input></form><article><h1>{T}</h1>{P3}</article>{FOOT}", WHOLE),
    "comments section": (f"<main><h1>{T}</h1>{P3}<section id='comments'><h3>2 comments</h3><p>I saw it from my window.</p><p>Stay safe everyone!</p></section></main>", WHOLE),
    "comments list": (f"{NAV}<article><h1>{T}</h1>{P3}</article><ol class='commentlist'><li>Terrible news.</li><li>My cellar is full of water.</li></ol>{FOOT}", WHOLE),
    "comments as articles": (f"{NAV}<main><h1>{T}</h1>{P3}</main><div id='comments'><article class='comment'><p>Great report, thank you.</p></article></div>{FOOT}", WHOLE),
    "aside with heading": (f"<main><h1>{T}</h1>{P3}<aside><h2>Weather</h2><p>More rain is expected.</p></aside></main>", WHOLE),
    "sidebar": (f"{NAV}<div class='sidebar'><h3>Most read</h3><ul><li><a href='/1'>Cat rescued</a></li></ul></div><div class='post-content'><h1>{T}</h1>{P3}</div>{FOOT}", WHOLE),
    "cookie notice": (f"<div class='cookie-banner'>We use cookies to improve this site. <a href='/c'>Accept all</a></div>{NAV}<article><h1>{T}</h1>{P3}</article>{FOOT}", WHOLE),
    "advert inside": (f"{NAV}<article><h1>{T}</h1><p>{A}</p><div class='ad'>Buy rubber boots now.</div><p>{B}</p><p>{C}</p></article>{FOOT}", WHOLE),
    "share links": (f"{NAV}<article><h1>{T}</h1>{P3}<div class='share-buttons'><ul><li><a href='/f'>Share</a></li></ul></div></article>{FOOT}", WHOLE),
    "site header": (f"<header><p>The Daily Example</p></header>{NAV}<article><h1>{T}</h1>{P3}</article>{FOOT}", WHOLE),
    "quote and list": (f"{NAV}<article><h1>{T}</h1><p>{A}</p><blockquote>{B}</blockquote><ul><li>{C}</li></ul></article>{FOOT}", WHOLE),
    "wrapped": (f"<div id='page'><div class='wrapper'>{NAV}<div class='content main-text'><h1>{T}</h1>{P3}</div></div>{FOOT}</div>", WHOLE),
    "unclosed": (f"{NAV}<article><h1>{T}</h1><p>{A}<p>{B}<p>{C}</article>{FOOT}", WHOLE),
    "entities": (f"{NAV}<article><h1>{T}</h1><p>Tom &amp; Ann said &quot;no&quot; to the new dam at the old mill.</p><p>{A}</p></article>{FOOT}", [T, 'Tom & Ann said "no" to the new dam at the old mill.', A]),
    "table layout": (f"{NAV}<table><tr><td class='mid'><h1>{T}</h1>{P3}</td></tr></table>{FOOT}", WHOLE),
    "only links": (NAV + FOOT, []),
    "script inside": (f"{NAV}<article><h1>{T}</h1><script>var a='<p>no</p>';</script>{P3}<style>p{{}}</style></article>{FOOT}", WHOLE),
    "two headings": (f"{NAV}<article><h1>{T}</h1><p>{A}</p><h2>At the market</h2><p>{B}</p></article>{FOOT}", [T, A, "At the market", B]),
    "related": (f"{NAV}<div class='entry-content'><h1>{T}</h1>{P3}</div><div class='related-posts'><h3>Related articles</h3><ul><li><a href='/2'>Storm in the hills</a></li></ul></div>{FOOT}", WHOLE),
}


@pytest.fixture(scope="module")
def weights(spark):
    return H.learn(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def text_of(weights, body):
    blocks = H.blocks_of(page(body))
    chosen = H.probabilities(weights, [H.features(blocks)])[0]
    return [b.text for b, p in zip(blocks, chosen) if p >= 0.5]


@pytest.mark.parametrize("name", list(PAGES))
def test_page(weights, name):
    body, want = PAGES[name]
    assert text_of(weights, body) == want
