"""Pages of real layouts, written by hand, that the labeller was not trained on."""

from quern.llm.html import blocks, labeller

# fmt: off
P1 = "The committee met on Tuesday to discuss the new bridge, which has been planned for years. Residents spoke for more than two hours."
Q1 = "Costs have risen since the first estimate was made, the engineer said, and the old foundations need more work than expected."
R1 = "A decision is due in the autumn; until then the ferry will keep running every half hour."
PAGES_1 = {
"blog": (f"""<!doctype html><html><head><title>Bridge - My Blog</title><link rel=stylesheet href=x.css></head><body class="post-template-default single single-post postid-12">
<a class="skip-link screen-reader-text" href="#content">Skip to content</a><header id="masthead" class="site-header"><div class="site-branding"><p class="site-title"><a href="/">My Blog</a></p><p class="site-description">Notes from the river</p></div>
<nav id="site-navigation" class="main-navigation"><button class="menu-toggle">Menu</button><div class="menu-main-container"><ul id="primary-menu" class="menu"><li class="menu-item"><a href="/">Home</a></li><li class="menu-item"><a href="/about">About</a></li></ul></div></nav></header>
<main id="primary" class="site-main"><article id="post-12" class="post-12 post type-post"><header class="entry-header"><h1 class="entry-title">A new bridge</h1></header><div class="entry-content"><p>{P1}</p><p>{Q1}</p><h2>What comes next</h2><p>{R1}</p></div></article></main>
<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts</h2><ol class="comment-list"><li class="comment"><div class="comment-body"><p>I would rather keep the ferry, it is part of the town.</p></div></li></ol><div id="respond" class="comment-respond"><h3>Leave a Reply</h3><form class="comment-form"><label>Comment</label><textarea></textarea><input type=submit></form></div></div>
<aside id="secondary" class="widget-area"><section class="widget widget_recent_entries"><h2 class="widget-title">Recent Posts</h2><ul><li><a href="/a">Spring floods</a></li><li><a href="/b">The old mill</a></li></ul></section></aside>
<footer id="colophon" class="site-footer"><div class="site-info">Proudly powered by a blog engine</div></footer></body></html>""", ["A new bridge",P1,Q1,"What comes next",R1]),
"wiki": (f"""<html><body class="mediawiki ltr ns-0 page-Bridge"><div id="mw-page-base" class="noprint"></div><div id="content" class="mw-body" role="main"><h1 id="firstHeading" class="firstHeading">Bridge</h1><div id="bodyContent" class="mw-body-content"><div id="mw-content-text"><div class="mw-parser-output"><p>{P1}</p><h2><span class="mw-headline" id="History">History</span></h2><p>{Q1}</p><ul><li>First span built</li><li>Second span built</li></ul><p>{R1}</p></div></div></div></div>
<div id="mw-navigation"><div id="mw-head"><div id="p-personal" role="navigation"><ul><li><a href="/login">Log in</a></li><li><a href="/create">Create account</a></li></ul></div></div><div id="mw-panel"><div role="navigation" class="portal"><h3>Tools</h3><ul><li><a href="/x">What links here</a></li><li><a href="/y">Related changes</a></li></ul></div></div></div>
<div id="footer" role="contentinfo"><ul id="footer-info"><li>This page was last edited on 3 May.</li></ul></div></body></html>""", ["Bridge",P1,"History",Q1,"First span built","Second span built",R1]),
"tables": (f"""<html><body bgcolor=white><table width=100%><tr><td colspan=2 class=banner><img src=logo.gif><font size=+2>Town Gazette</font></td></tr><tr><td width=150 valign=top class=navcol><a href=1.html>Front page</a><br><a href=2.html>Sport</a><br><a href=3.html>Weather</a></td><td valign=top><h2>A new bridge</h2><p>{P1}<p>{Q1}<p>{R1}</td></tr><tr><td colspan=2 class=bottom><font size=-1>Copyright Town Gazette. All rights reserved.</font></td></tr></table></body></html>""", ["A new bridge",P1,Q1,R1]),
"docs": (f"""<html><body><div class="md-header" data-md-component="header"><nav class="md-header__inner"><a href="." class="md-logo">Docs</a><form class="md-search__form"><input type=text placeholder=Search></form></nav></div><div class="md-container"><main class="md-main"><div class="md-main__inner"><div class="md-sidebar md-sidebar--primary"><nav class="md-nav"><ul class="md-nav__list"><li class="md-nav__item"><a href=a>Installation</a></li><li class="md-nav__item"><a href=b>Usage</a></li></ul></nav></div><div class="md-content"><article class="md-content__inner"><h1 id=usage>Usage</h1><p>{P1}</p><pre><code>run --fast input.txt</code></pre><p>{R1}</p></article></div></div></main><footer class="md-footer"><div class="md-copyright">Made with a generator</div></footer></div></body></html>""", ["Usage",P1,"run --fast input.txt",R1]),
"news": (f"""<html><body><div id="consent-overlay" class="gdpr-modal" role="dialog"><p>We and our partners use cookies to personalise content and ads.</p><button>Accept all</button></div><header class="page-header"><nav aria-label="Main"><a href=/>News</a><a href=/s>Sport</a></nav></header><main><div class="story"><h1 class="headline">A new bridge</h1><div class="byline">By our correspondent</div><div class="story-body"><p>{P1}</p><div class="advert"><span>Advertisement</span></div><p>{Q1}</p><aside class="related-links"><h3>Read more</h3><ul><li><a href=/m>Ferry fares rise</a></li></ul></aside><p>{R1}</p></div></div></main><section class="newsletter-signup"><h3>Get our newsletter</h3><form><input type=email><button>Sign up</button></form></section><footer><p>© News Company</p></footer></body></html>""", ["A new bridge",P1,Q1,R1]),
"generic classes": (f"""<html><body><div class="a1"><div class="b2"><a href=/>Start</a> <a href=/n>Neues</a> <a href=/k>Kontakt</a></div></div><div class="c3"><div class="d4"><h1>A new bridge</h1><p>{P1}</p><p>{Q1}</p><p>{R1}</p></div><div class="e5"><a href=/1>Older story</a><a href=/2>Another one</a></div></div><div class="f6">© 2024 Impressum</div></body></html>""", ["A new bridge",P1,Q1,R1]),
}

P2 = "Soak the beans overnight in plenty of cold water, then drain them and rinse them well before cooking."
Q2 = "Bring a large pot to the boil, add the beans with two bay leaves, and let everything simmer for about an hour and a half."
R2 = "Season only at the end, because salt keeps the skins hard for longer than most cooks would like."
PAGES_2 = {
"recipe": (f"""<html lang=en><head><title>Bean stew</title><script type="application/ld+json">{{"a":1}}</script></head><body class="recipe-template"><div id="__next"><div class="topbar"><a class="logo" href="/">Kitchen</a><ul class="topbar-menu"><li><a href=/s>Soups</a></li><li><a href=/c>Cakes</a></li></ul><form role=search><input><button>Search</button></form></div>
<div class="recipe-page"><div class="breadcrumbs"><a href=/>Home</a> &gt; <a href=/s>Soups</a></div><div class="recipe-content"><h1 class="recipe-title">Bean stew</h1><p class="intro">{R2}</p><h2>Ingredients</h2><ul class="ingredients"><li>500 g dried beans</li><li>2 bay leaves</li></ul><h2>Method</h2><ol class="steps"><li>{P2}</li><li>{Q2}</li></ol></div><div class="share-buttons"><a href=#f>Share</a><a href=#p>Pin</a></div><div class="reviews" id="comments"><h3>Comments (1)</h3><div class="review"><strong>Ann</strong><p>We cooked this twice last week and loved it.</p></div></div></div><div class="bottom-footer"><a href=/privacy>Privacy</a> <a href=/terms>Terms</a><p>© Kitchen Media</p></div></div></body></html>""",["Bean stew",R2,"Ingredients","500 g dried beans","2 bay leaves","Method",P2,Q2]),
"government": (f"""<html><body><a href="#main" class="visually-hidden">Skip to main content</a><div id="global-cookie-message" role="region"><p>Tell us whether you accept cookies</p><button>Accept</button></div><header role="banner" id="global-header"><a href=/>GOV</a></header><div id="wrapper"><main role="main" id="main"><div class="grid-row"><div class="column-two-thirds"><h1 class="heading-xlarge">Cooking beans safely</h1><div class="govspeak"><p>{P2}</p><h2 id=heat>Heat</h2><p>{Q2}</p><p>{R2}</p></div></div><div class="column-third"><aside class="related" role="complementary"><h2>Related content</h2><ul><li><a href=/x>Food hygiene</a></li></ul></aside></div></div></main></div><footer role="contentinfo" class="group js-footer"><ul><li><a href=/h>Help</a></li></ul><p>All content is available under the open licence</p></footer></body></html>""",["Cooking beans safely",P2,"Heat",Q2,R2]),
"old home page": (f"""<HTML><HEAD><TITLE>Beans</TITLE></HEAD><BODY BGCOLOR="#FFFFFF"><CENTER><H1>All about beans</H1></CENTER><HR><P>{P2}<P>{Q2}<BLOCKQUOTE>{R2}</BLOCKQUOTE><HR><A HREF="index.html">Home</A> | <A HREF="links.html">Links</A> | <A HREF="mailto:x">Mail me</A></BODY></HTML>""",["All about beans",P2,Q2,R2]),
"magazine": (f"""<html><body><div class="ad-slot ad-slot--top"><p>Advertisement</p></div><header class="masthead"><h2>Slow Food Monthly</h2><nav><a href=/1>Issues</a><a href=/2>Subscribe</a></nav></header><div class="layout"><article class="feature"><header><h1>The patience of beans</h1><p class="standfirst">{R2}</p></header><section class="feature__body"><p>{P2}</p><figure><img src=a><figcaption>Beans at the market</figcaption></figure><div class="promo promo--inline"><p>Subscribe now and save half</p></div><p>{Q2}</p></section></article><aside class="rail"><h3>Most read</h3><ol><li><a href=/9>Ten ways with lentils</a></li></ol></aside></div><div class="newsletter-bar"><form><label>Your email</label><button>Sign up</button></form></div><footer class="foot"><small>Slow Food Monthly is printed on recycled paper</small></footer></body></html>""",["The patience of beans",R2,P2,"Beans at the market",Q2]),
}
# fmt: on


def right(pages):
    """Blocks that are labelled rightly, and all blocks."""
    good = total = 0
    for page, want in pages.values():
        found = blocks(page)
        for text, score in zip(found.texts, labeller().score([found])[0]):
            good += (text in set(want)) == (score >= 0.5)
            total += 1
    return good, total


def test_layouts_at_hand_while_the_generator_was_made():
    good, total = right(PAGES_1)
    assert good >= 0.85 * total


def test_layouts_written_afterwards():
    good, total = right(PAGES_2)
    assert good >= 0.85 * total
