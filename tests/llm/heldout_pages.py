"""Pages written by hand in the manner of common site software, unlike those that the model is fitted on; in each, what a reader would call the article."""

PAGES = [
    # a blog
    (
        """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Sourdough at altitude – The Crumb</title><link rel="stylesheet" href="s.css"><style>.a{color:red}</style></head>
<body class="single single-post postid-812"><a class="skip-link screen-reader-text" href="#primary">Skip to content</a>
<div id="page" class="hfeed site"><header id="masthead" class="site-header"><div class="site-branding"><p class="site-title"><a href="/" rel="home">The Crumb</a></p><p class="site-description">Bread, mostly</p></div>
<nav id="site-navigation" class="main-navigation"><button class="menu-toggle">Menu</button><ul><li class="menu-item"><a href="/about">About</a></li><li class="menu-item"><a href="/recipes">Recipes</a></li></ul></nav></header>
<div id="content" class="site-content"><main id="primary" class="content-area"><article id="post-812" class="post type-post hentry">
<h1 class="entry-title">Sourdough at altitude</h1>
<div class="entry-content"><p>Above two thousand metres water boils early and dough rises fast, which surprises most people who move here.</p><p>I keep the levain small &amp; cold, and shorten the bulk rise by a third.</p>
<h2>What to change</h2><ul><li>Use about five per cent more water.</li><li>Bake hotter for the first ten minutes.</li></ul><p>The rest is patience.</p></div></article>
<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts on this post</h2><ol class="comment-list"><li class="comment even"><article class="comment-body"><div class="comment-content"><p>My loaves collapsed until I tried this, thank you so much for writing it up.</p></div></article></li></ol><form class="comment-form"><label>Leave a reply</label><textarea></textarea></form></div></main>
<aside id="secondary" class="widget-area"><section class="widget widget_recent_entries"><h2 class="widget-title">Recent posts</h2><ul><li><a href="/rye">Rye without tears</a></li></ul></section></aside></div>
<footer id="colophon" class="site-footer"><div class="site-info">Proudly powered by flour. Copyright 2024.</div></footer></div><script>var x = 1 < 2;</script></body></html>""",
        ["Sourdough at altitude", "Above two thousand metres water boils early and dough rises fast, which surprises most people who move here.", "I keep the levain small & cold, and shorten the bulk rise by a third.", "What to change", "Use about five per cent more water.", "Bake hotter for the first ten minutes.", "The rest is patience."],
    ),
    # documentation of a program
    (
        """<html><head><title>Queues — Manual</title></head><body role="document"><div class="related" role="navigation" aria-label="related navigation"><h3>Navigation</h3><ul><li class="right"><a href="genindex.html">index</a></li><li class="right"><a href="pools.html">next</a> |</li></ul></div>
<div class="document"><div class="documentwrapper"><div class="bodywrapper"><div class="body" role="main"><section id="queues"><h1>Queues<a class="headerlink" href="#queues"></a></h1><p>A queue hands items from producers to consumers in the order in which they came.</p>
<pre>q = Queue(maxsize=8)\nq.put("x")</pre><p>When the queue is full, <code>put</code> waits until there is room again. See <a href="pools.html">pools</a> for an alternative.</p><dl><dt>maxsize</dt><dd><p>The number of items that may wait.</p></dd></dl></section></div></div></div>
<div class="sphinxsidebar" role="navigation"><div class="sphinxsidebarwrapper"><h3><a href="index.html">Table of Contents</a></h3><ul><li><a href="#queues">Queues</a></li></ul><div id="searchbox"><form class="search" action="search.html"><input type="text" name="q"><input type="submit" value="Go"></form></div></div></div></div>
<div class="footer" role="contentinfo">Last updated on 3 May. Created with a generator.</div></body></html>""",
        ["Queues", "A queue hands items from producers to consumers in the order in which they came.", 'q = Queue(maxsize=8) q.put("x")', "When the queue is full, put waits until there is room again. See pools for an alternative.", "maxsize", "The number of items that may wait."],
    ),
    # an encyclopedia
    (
        """<html><body class="mediawiki"><div id="mw-navigation"><h2>Navigation menu</h2><div id="mw-head"><ul class="vector-menu-content-list"><li><a href="/login">Log in</a></li></ul></div><div id="mw-panel"><a href="/main">Main page</a><a href="/random">Random article</a></div></div>
<div id="content" class="mw-body" role="main"><h1 id="firstHeading" class="firstHeading">Alpine chough</h1><div id="bodyContent"><div id="siteSub" class="noprint">From a free encyclopedia</div><div id="mw-content-text" class="mw-body-content"><div class="mw-parser-output">
<p>The <b>Alpine chough</b> is a bird in the crow family, one of only two species in its genus. It may nest at a higher altitude than any other bird.</p><h2>Description</h2><p>It has glossy black plumage, a yellow bill and red legs.</p><table class="wikitable"><tr><th>Length</th><td>37 to 39 cm</td></tr></table><p>Its calls are rippling and quite unlike those of its relatives.</p></div></div></div></div>
<footer id="footer" class="mw-footer" role="contentinfo"><ul id="footer-info"><li>This page was last edited on a Tuesday.</li><li>Text is available under a free licence.</li></ul></footer></body></html>""",
        ["Alpine chough", "The Alpine chough is a bird in the crow family, one of only two species in its genus. It may nest at a higher altitude than any other bird.", "Description", "It has glossy black plumage, a yellow bill and red legs.", "Length", "37 to 39 cm", "Its calls are rippling and quite unlike those of its relatives."],
    ),
    # tables for layout, capitals, no closing tags
    (
        """<HTML><BODY BGCOLOR=white><TABLE WIDTH="100%"><TR><TD COLSPAN=2><A HREF="index.htm">Home</A> | <A HREF="news.htm">News</A> | <A HREF="links.htm">Links</A></TD></TR>
<TR><TD CLASS="menu" WIDTH=120><A HREF="a.htm">Gallery</A><BR><A HREF="b.htm">Guestbook</A></TD><TD CLASS="content"><H1>Restoring a mantel clock</H1><P>My grandfather's clock had stood still since nineteen sixty when I opened its case for the first time.
<P>The mainspring was whole, but the pivots were worn and the oil had long since turned to glue.<P>After a bath in petrol &mdash; outdoors, please &mdash; it ran within two minutes a day.</TD></TR>
<TR><TD COLSPAN=2 CLASS="footer">Webmaster: mail me. Best viewed at 800x600.</TD></TR></TABLE></BODY></HTML>""",
        ["Restoring a mantel clock", "My grandfather's clock had stood still since nineteen sixty when I opened its case for the first time.", "The mainspring was whole, but the pivots were worn and the oil had long since turned to glue.", "After a bath in petrol — outdoors, please — it ran within two minutes a day."],
    ),
    # a newspaper
    (
        """<html><body><div class="gdpr-overlay" role="dialog" aria-modal="true"><p>We value your privacy. We and our partners store information on your device.</p><button>Accept all</button></div><header class="page-header"><a href="/">The Harbour Times</a><nav class="primary-nav"><a href="/politics">Politics</a><a href="/sport">Sport</a></nav></header>
<main><div class="advert leaderboard"><span>Advertisement</span><p>Win a cruise for two with our partners at the docks.</p></div><article class="story" itemscope><h1 itemprop="headline">Ferry line to close after ninety years</h1><div class="story-body" itemprop="articleBody"><p>The last ferry between the two banks will sail on Sunday, the company said in a short statement.</p><p>Passengers have fallen by half since the bridge was opened.</p>
<div class="newsletter-signup"><p>Get the morning briefing in your inbox every day of the week.</p><form><input type="email"><button>Sign up</button></form></div><p>“It was a good line,” said its oldest captain, who has steered it for four decades.</p><figure><img src="f.jpg"><figcaption>The ferry at its berth.</figcaption></figure></div></article>
<section class="related-stories"><h2>More on this story</h2><ul><li><a href="/1">Bridge tolls to rise next year</a></li><li><a href="/2">A day on the water</a></li></ul></section></main><footer class="page-footer"><p>All rights reserved by the Harbour Times. Terms and privacy.</p></footer></body></html>""",
        ["Ferry line to close after ninety years", "The last ferry between the two banks will sail on Sunday, the company said in a short statement.", "Passengers have fallen by half since the bridge was opened.", "“It was a good line,” said its oldest captain, who has steered it for four decades.", "The ferry at its berth."],
    ),
    # a shop's journal, boxes without meaning
    (
        """<html><body><div class="css-1k2"><div class="css-9a0 topbar"><a href="/cart">Cart (0)</a> <a href="/account">Account</a></div><div class="css-77x"><div class="css-aa1"><h1>How our pans are made</h1><p>Each pan begins as a flat disc of steel that is pressed into shape in three strokes.</p><p>Handles are riveted by hand, two people to a line, about four hundred a day.</p><p>We season every pan twice before it leaves the works, so that it can be used at once.</p></div>
<div class="css-promo1 promo"><p>Free shipping on all orders over fifty. Use code PAN10 at checkout.</p><a href="/shop">Shop now</a></div></div><div class="css-fff footer-links"><a href="/returns">Returns</a><a href="/contact">Contact</a><p>Made with care since 1931.</p></div></div></body></html>""",
        ["How our pans are made", "Each pan begins as a flat disc of steel that is pressed into shape in three strokes.", "Handles are riveted by hand, two people to a line, about four hundred a day.", "We season every pan twice before it leaves the works, so that it can be used at once."],
    ),
    # a recipe
    (
        """<html><body><div id="app"><nav class="navbar navbar-expand-lg"><div class="container"><a class="navbar-brand" href="/">Spoonful</a><ul class="navbar-nav"><li class="nav-item"><a class="nav-link" href="/soups">Soups</a></li></ul></div></nav><nav aria-label="breadcrumb"><ol class="breadcrumb"><li class="breadcrumb-item"><a href="/">Home</a></li><li class="breadcrumb-item active">Leek soup</li></ol></nav>
<div class="container"><div class="row"><div class="col-md-8"><article class="recipe"><h1>Leek soup</h1><p>A soup for the first cold evening of the year.</p><h2>Ingredients</h2><ul><li>Three leeks</li><li>Two potatoes</li><li>One litre of stock</li></ul><h2>Method</h2><ol><li>Sweat the leeks in butter until they are soft.</li><li>Add potatoes and stock, and simmer for twenty minutes.</li></ol></article></div>
<div class="col-md-4 sidebar"><div class="card"><div class="card-body"><h5>About the cook</h5><p>Ines has cooked for thirty years in kitchens large and small.</p></div></div></div></div></div><footer class="bg-light"><div class="container"><p>Spoonful is a registered trademark.</p></div></footer></div></body></html>""",
        ["Leek soup", "A soup for the first cold evening of the year.", "Ingredients", "Three leeks", "Two potatoes", "One litre of stock", "Method", "Sweat the leeks in butter until they are soft.", "Add potatoes and stock, and simmer for twenty minutes."],
    ),
    # hardly any markup
    (
        """<title>Notes</title><h1>On keeping notes</h1><p>Write every day, even if it is only a line, and put a date to it.<p>Never tidy old notes; the mess is the record.<p>What you look up twice belongs in the index.<hr><address>me@home</address>""",
        ["On keeping notes", "Write every day, even if it is only a line, and put a date to it.", "Never tidy old notes; the mess is the record.", "What you look up twice belongs in the index."],
    ),
    # a page of a council, with notices
    (
        """<html><body><div class="govuk-cookie-banner" role="region" aria-label="Cookies"><h2>Cookies on this service</h2><p>We use some essential cookies to make this service work.</p><button>Accept</button></div><header role="banner" class="govuk-header"><a href="/">Town council</a></header><div class="alert alert-warning" role="alert"><strong>The offices are closed on Monday.</strong></div>
<main class="govuk-main-wrapper" id="main-content" role="main"><h1 class="govuk-heading-xl">Apply for a parking permit</h1><p class="govuk-body">You need a permit to park in the old town between eight and six.</p><p class="govuk-body">A permit costs sixty a year and is valid for one car.</p><h2>Before you start</h2><p>Have your registration document at hand.</p></main>
<footer class="govuk-footer" role="contentinfo"><ul><li><a href="/help">Help</a></li><li><a href="/privacy">Privacy</a></li></ul><span>Licensed openly unless stated otherwise.</span></footer></body></html>""",
        ["Apply for a parking permit", "You need a permit to park in the old town between eight and six.", "A permit costs sixty a year and is valid for one car.", "Before you start", "Have your registration document at hand."],
    ),
    # a forum's first post
    (
        """<html><body><div id="header-bar"><ul class="nav-tabs"><li><a href="/forum">Forum</a></li><li><a href="/members">Members</a></li></ul></div><div class="p-body"><div class="p-body-main"><h1 class="p-title-value">Squeaking bottom bracket, solved</h1><div class="message-body"><div class="bbWrapper"><p>For months my bicycle squeaked on every climb, and three shops found nothing.</p><p>In the end it was the seat post: a drop of oil, and silence.</p></div></div></div>
<div class="p-body-sidebar"><div class="block"><h3>Members online</h3><p>Guests: 214. Robots: 31.</p></div></div></div><div class="comments replies"><div class="comment"><p>Same here! I had replaced half of the drivetrain before I looked at the saddle.</p></div></div><footer class="p-footer"><a href="/terms">Terms</a><p>Forum software of some kind.</p></footer></body></html>""",
        ["Squeaking bottom bracket, solved", "For months my bicycle squeaked on every climb, and three shops found nothing.", "In the end it was the seat post: a drop of oil, and silence."],
    ),
]
