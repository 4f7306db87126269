"""Labelled pages: invented HTML of common layouts, each with its main text.

The weights of the extraction are fitted on these unless the caller gives
others. Blocks of the main text are separated by empty lines.
"""

from __future__ import annotations

PAGES: tuple[tuple[str, str], ...] = (
    (
        """<html><head><title>Rivers - Field notes</title><style>p{color:red}</style></head><body>
<header><div class="logo">Field notes</div><nav class="menu"><ul><li><a href="/">Home</a></li><li><a href="/a">About</a></li>
<li><a href="/c">Contact</a></li></ul></nav></header>
<article><h1>How rivers move</h1><p>A river carries stones and sand towards the sea.</p><p>Where it slows down, it
drops them and <b>builds</b> new <a href="/land">land</a> over the years.</p><ul><li>Gravel falls first.</li><li>Clay
falls last.</li></ul></article><aside class="sidebar"><h3>Popular posts</h3><ul><li><a href="/1">Ten lakes to
see</a></li><li><a href="/2">Why ice floats</a></li></ul></aside>
<footer><p>Copyright Field notes. All rights reserved.</p></footer></body></html>""",
        "How rivers move\n\nA river carries stones and sand towards the sea.\n\nWhere it slows down, it drops them and builds new land over the years.\n\nGravel falls first.\n\nClay falls last.",
    ),
    (
        """<html><body><div class="cookie-notice">We use cookies to make this site better. <button>Accept</button></div>
<nav><a href="/">Start</a> <a href="/news">News</a> <a href="/sport">Sport</a></nav>
<main><article><header><h1>Council votes for new bridge</h1><p>The vote was close after a long evening.</p></header>
<p>Work is to begin in spring and to last for two years, the mayor said on Monday.</p>
<div class="ad">Buy one pair of shoes and get one free today only.</div>
<blockquote><p>We have waited for this since my childhood.</p></blockquote>
<p>Shops in the old town hope for more visitors.</p></article>
<section id="comments" class="comments"><h2>Reader comments</h2><div class="comment"><p>At last somebody does
something about it.</p></div><div class="comment"><p>And who is going to pay for all of that?</p></div>
<form class="comment-form"><label>Your comment</label><textarea>Write here</textarea><button>Send</button></form></section></main>
<footer><ul><li><a href="/imprint">Imprint</a></li><li><a href="/privacy">Privacy</a></li></ul></footer></body></html>""",
        "Council votes for new bridge\n\nThe vote was close after a long evening.\n\nWork is to begin in spring and to last for two years, the mayor said on Monday.\n\nWe have waited for this since my childhood.\n\nShops in the old town hope for more visitors.",
    ),
    (
        """<html><body><div id="header"><a href="/">The kitchen table</a><form class="search"><input name="q"><button>Search
</button></form></div><div id="menu" class="navigation"><a href="/soups">Soups</a><a href="/cakes">Cakes</a></div>
<div id="content" class="post"><h1>Plain bread</h1><p>Mix flour, water, salt and yeast in a large bowl.</p>
<h2>Resting</h2><p>Leave the dough alone for an hour or two, until it has doubled.</p><ol><li>Heat the oven well.</li>
<li>Bake until it sounds hollow.</li></ol><table><tr><td>Flour</td><td>500 grams</td></tr></table></div>
<div class="sidebar widget"><h3>Newsletter</h3><p>Subscribe and get a recipe every week.</p><form class="newsletter"><input>
<button>Subscribe</button></form></div><div class="related"><h3>You may also like</h3><p><a href="/r">Rolls with seeds
</a></p></div><div id="footer"><p>Made by people who like to eat. <a href="/p">Privacy policy</a></p></div></body></html>""",
        "Plain bread\n\nMix flour, water, salt and yeast in a large bowl.\n\nResting\n\nLeave the dough alone for an hour or two, until it has doubled.\n\nHeat the oven well.\n\nBake until it sounds hollow.\n\nFlour\n\n500 grams",
    ),
    (
        """<html><body><div class="banner promo">Winter sale, everything must go.</div><div class="breadcrumb"><a href="/">Home
</a> / <a href="/g">Guides</a></div><h1>Choosing a bicycle</h1><p>Think first about the roads that you ride on most.</p>
<p>A light frame helps on hills, a strong one under luggage.<br>Tyres matter more than most people think.</p>
<p>Try several before you buy one.</p><div class="share social"><a href="/s">Share</a> <a href="/t">Tweet</a></div>
<div class="author-bio"><p>The writer has toured for many years.</p></div><p class="copyright">Copyright, all rights reserved.</p>
<script>track("<p>page</p>");</script></body></html>""",
        "Choosing a bicycle\n\nThink first about the roads that you ride on most.\n\nA light frame helps on hills, a strong one under luggage. Tyres matter more than most people think.\n\nTry several before you buy one.",
    ),
    (
        """<html><body><div class="notice alert">This site will be down on Sunday for repairs.</div><div class="top"><ul
class="nav"><li><a href="/1">Physics</a></li><li><a href="/2">Chemistry</a></li><li><a href="/3">Biology</a></li></ul></div>
<div class="wrapper"><div class="entry-content article-body"><h2>Why the sky is blue</h2><p>Sunlight holds all colours, and
air scatters the short waves most.</p><p>In the evening the light takes a longer way, and <em>red</em> is left.</p>
<pre>scattering grows with the fourth power</pre></div><div class="sponsored advert"><p>Sponsored: learn anything from home
in three weeks.</p></div></div><div class="replies discussion"><ul><li><p>Thanks, I have always wondered.</p></li><li><p>My
teacher told us the same.</p></li></ul></div><footer class="site-footer"><p>Contact us at any time.</p></footer></body></html>""",
        "Why the sky is blue\n\nSunlight holds all colours, and air scatters the short waves most.\n\nIn the evening the light takes a longer way, and red is left.\n\nscattering grows with the fourth power",
    ),
    (
        """<html><body><header class="site-header"><a href="/">Town paper</a><p>Independent since the last century.</p></header>
<main><h1>Library opens on Sundays</h1><p>From May on the doors are open all week.</p><figure><img src="l.jpg"><figcaption>The
reading room.</figcaption></figure><p>Volunteers look after the rooms, and books can be returned at any hour.</p>
<aside><p>More on this: opening hours of the pools.</p></aside><p>Entry stays free.</p></main>
<div class="popup modal consent"><p>Please agree to our terms and to the use of your data.</p></div>
<footer>Town paper, printed on old paper. <a href="/f">Feedback</a></footer></body></html>""",
        "Library opens on Sundays\n\nFrom May on the doors are open all week.\n\nThe reading room.\n\nVolunteers look after the rooms, and books can be returned at any hour.\n\nEntry stays free.",
    ),
    (
        """<html><body><nav><ul><li><a href="/de">Deutsch</a></li><li><a href="/fr">Fran&ccedil;ais</a></li></ul></nav>
<div class="ad">Neue Reifen zum halben Preis, nur in dieser Woche.</div><article><h1>Der Wald im Winter</h1><p>Im Winter ruhen
die B&auml;ume, aber sie schlafen nicht.</p><p><b>Unter dem Schnee bleibt der Boden weich.<br><p>Im Fr&uuml;hjahr steigt der Saft
wieder in die Zweige.</p></article><footer>&copy; waldblatt &middot; Alle Rechte vorbehalten und kein Nachdruck.</footer></body></html>""",
        "Der Wald im Winter\n\nIm Winter ruhen die Bäume, aber sie schlafen nicht.\n\nUnter dem Schnee bleibt der Boden weich.\n\nIm Frühjahr steigt der Saft wieder in die Zweige.",
    ),
    (
        """<html><body><header><h2><a href="/">Garden year</a></h2><nav class="main-menu"><ul><li><a href="/s">Spring</a></li>
<li><a href="/w">Winter</a></li></ul></nav></header><article class="post"><h1>What to sow in March</h1><p>Some plants like
the cold, as our <a href="/list">long list</a> shows.</p><ul><li>Spinach can go straight into the open ground.</li><li>Broad
beans stand a little frost.</li><li>Onions want a sunny <strong>bed</strong> without fresh manure.</li></ul><h3>Under
glass</h3><ol><li>Tomatoes need a warm window.</li><li>Peppers take longest, so begin early.</li></ol><p>Water with
care.</p></article><div id="disqus" class="comment-list"><ol><li><div class="comment-body"><p>My beans froze last
year.</p></div></li></ol></div><aside><ul><li><a href="/x">Seeds by post</a></li></ul></aside></body></html>""",
        "What to sow in March\n\nSome plants like the cold, as our long list shows.\n\nSpinach can go straight into the open ground.\n\nBroad beans stand a little frost.\n\nOnions want a sunny bed without fresh manure.\n\nUnder glass\n\nTomatoes need a warm window.\n\nPeppers take longest, so begin early.\n\nWater with care.",
    ),
    (
        """<html><body><div class="nav"><ul><li><a href="/">Index</a></li></ul></div><div id="main"><h1>Rules of the house</h1>
<div>Everyone who lives here keeps to a few rules, and they are short.</div><ul><li>Quiet after ten at night.</li><li>Bicycles
stay in the yard.</li><li>The last one out locks the gate, and the first one in lights the stove.</li></ul><div>Whoever breaks
one cooks for all.</div><h2>Guests</h2><section><p>Guests are welcome for a week.</p></section></div>
<div class="footer-links"><a href="/t">Terms</a></div></body></html>""",
        "Rules of the house\n\nEveryone who lives here keeps to a few rules, and they are short.\n\nQuiet after ten at night.\n\nBicycles stay in the yard.\n\nThe last one out locks the gate, and the first one in lights the stove.\n\nWhoever breaks one cooks for all.\n\nGuests\n\nGuests are welcome for a week.",
    ),
    (
        """<html><body><div class="top-nav"><a href="/">Home</a> <a href="/walks">Walks</a> <a href="/maps">Maps</a></div>
<div><div><h1>Along the old canal</h1><div>The path begins behind the mill and follows the water for nine miles.</div>
<div>Boats were pulled here by horses until the railway came, and the stones still show where the ropes ran.</div>
<div>Bring good shoes, since the ground stays wet well into the summer months.</div></div></div>
<div class="footer"><div>All rights reserved by the walking club.</div></div></body></html>""",
        "Along the old canal\n\nThe path begins behind the mill and follows the water for nine miles.\n\nBoats were pulled here by horses until the railway came, and the stones still show where the ropes ran.\n\nBring good shoes, since the ground stays wet well into the summer months.",
    ),
    (
        """<html><body><form method="post" action="./page.aspx" id="aspnetForm"><input type="hidden" name="state"><div id="topbar">
<ul class="menu"><li><a href="/">Start</a></li><li><a href="/services">Services</a></li></ul></div><div id="body"><h1>Renewing
a passport</h1><p>A passport can be renewed at any office of the district, on working days before noon.</p><p>Bring the old
one, a photograph and the fee, which has to be paid in cash.</p><div>The new passport is ready after three weeks.</div></div>
<div class="search"><label>Search this site</label><input><button>Go</button></div><div id="footer"><p>Contact and privacy.</p>
</div></form></body></html>""",
        "Renewing a passport\n\nA passport can be renewed at any office of the district, on working days before noon.\n\nBring the old one, a photograph and the fee, which has to be paid in cash.\n\nThe new passport is ready after three weeks.",
    ),
    (
        """<html><body><nav><a href="/">Front page</a></nav><article><h1>New clock for the tower</h1><p>The old clock
stopped in May.</p><p>A new one is to come soon.</p></article><div>I liked the old one much better than any new one.</div>
<div>Who is going to wind it up every week, if not the same people as before?</div><footer>Printed here.</footer></body></html>""",
        "New clock for the tower\n\nThe old clock stopped in May.\n\nA new one is to come soon.",
    ),
    (
        """<html><body><div class="navbar"><a href="/">Science today</a></div><main><h1>How bees find the way home</h1>
<article><p>Bees remember the sun and the hedges that they pass.</p><p>On cloudy days they see the light that clouds let
through.</p></article><div><p>My grandfather kept bees and never lost a swarm in all those years.</p></div><div><p>Great
article, thank you for that.</p></div></main><div class="site-info">Science today, every Tuesday.</div></body></html>""",
        "How bees find the way home\n\nBees remember the sun and the hedges that they pass.\n\nOn cloudy days they see the light that clouds let through.",
    ),
    (
        """<html><body><table><tr><td class="leftmenu"><a href="/1">Chapter one</a><br><a href="/2">Chapter two</a><br><a
href="/3">Chapter three</a></td><td><h2>The lighthouse keeper</h2>The keeper climbed the stairs at dusk, as every evening.<br>
<br>He lit the lamp and wrote the hour into the book, then he looked out over the dark water for a long time.</td></tr>
<tr><td class="bottom" colspan="2"><a href="/next">Next chapter</a></td></tr></table></body></html>""",
        "The lighthouse keeper\n\nThe keeper climbed the stairs at dusk, as every evening. He lit the lamp and wrote the hour into the book, then he looked out over the dark water for a long time.",
    ),
    (
        """<html><body><div id="page"><div id="masthead"><a href="/">Village voice</a></div><div id="primary"><div><h1>Harvest
supper</h1></div><div><span>The supper takes place on the last Saturday of the month, in the big barn.</span></div><div>Everybody
brings a dish, and the band plays until the last guest has gone.</div><div><ul><li>Doors open at six.</li><li>Children eat for
free.</li></ul></div></div><div class="subscribe"><form><p>Get our news by mail every week.</p><input><button>Sign
up</button></form></div></div></body></html>""",
        "Harvest supper\n\nThe supper takes place on the last Saturday of the month, in the big barn.\n\nEverybody brings a dish, and the band plays until the last guest has gone.\n\nDoors open at six.\n\nChildren eat for free.",
    ),
    (
        """<html><body><div class="head"><a href="/">Town guide</a></div><section><h1>Three days by the lake</h1><p>Most visitors
come for a day and wish that they had stayed.</p></section><section><h2>The first day</h2><p>Walk around the southern shore,
where the fishermen mend their nets in the morning.</p><p>Eat what they caught.</p></section><section><h2>The second day</h2>
<p>Take the small boat to the island and its garden.</p></section><section class="related-links"><h3>See also</h3><ul><li><a
href="/hills">The hills</a></li></ul></section><div class="copyright">Town guide and its friends.</div></body></html>""",
        "Three days by the lake\n\nMost visitors come for a day and wish that they had stayed.\n\nThe first day\n\nWalk around the southern shore, where the fishermen mend their nets in the morning.\n\nEat what they caught.\n\nThe second day\n\nTake the small boat to the island and its garden.",
    ),
)
