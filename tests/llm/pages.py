"""Pages written by hand for the tests, apart from the generator: in each, what stands in [[ ]] is main text."""

PAGES = {
    "plain columns": """<html><body><div class="top"><a href="/">Northern Gazette</a></div><div class="row"><div class="col"><ul><li><a href="/w">World</a></li><li><a href="/s">Sport</a></li><li><a href="/m">Money</a></li></ul></div>
        <div class="col"><h1>[[Ferry service returns to the islands]]</h1><p>[[After eleven months in dry dock the ferry made its first crossing on Monday, carrying forty passengers and a lorry of hay.]]</p>
        <p>[[The captain said that the sea had been calm, and that nobody had been ill.]]</p><p>[[Tickets cost the same as before.]]</p><h2>[[What comes next]]</h2><p>[[From June there will be two crossings a day, one of them at night, until the end of the season.]]</p></div>
        <div class="col"><h3>Most read</h3><ul><li><a href="/1">Storm closes school</a></li><li><a href="/2">New mayor sworn in</a></li></ul></div></div><div class="bottom">Copyright 2021 Northern Gazette. All rights reserved.</div></body></html>""",
    "layout table": """<table width=100%><tr><td colspan=3><font size=5>Harbour Club</font></td></tr><tr><td><a href=1>Home</a><br><a href=2>Members</a><br><a href=3>Links</a></td>
        <td><h2>[[Minutes of the spring meeting]]</h2><p>[[The treasurer reported that the club had spent less than planned on paint, and more on rope.]]</p><p>[[It was agreed to mend the slipway before the regatta, and to ask the council for help with the cost.]]</p>
        <p>[[The next meeting will be held in September, in the boat house.]]</p></td><td><b>Advertisement</b><br>Buy sails now!</td></tr><tr><td colspan=3>All rights reserved</td></tr></table>""",
    "preformatted": """<html><body><nav><a href="/">Docs</a> <a href="/api">API</a></nav><main><h1>[[Reading a file line by line]]</h1><p>[[The shortest way is a loop over the file object, which gives one line at a time and never holds the whole file.]]</p>
        <pre>[[with open("log.txt") as f: for line in f: print(line)]]</pre><p>[[Use a larger buffer where the lines are very short.]]</p></main><footer><p>&copy; 2020 The manual writers</p></footer></body></html>""",
    "definitions": """<body><header><h1>Garden words</h1></header><article><h1>[[Tools and what they are for]]</h1><p>[[Every shed has its own names for things; these are the ones in common use here.]]</p>
        <dl><dt>[[Dibber]]</dt><dd>[[A pointed stick for making holes in which seeds or bulbs are set.]]</dd><dt>[[Riddle]]</dt><dd>[[A coarse sieve that takes the stones out of the soil.]]</dd></dl></article>
        <aside><h3>See also</h3><ul><li><a href="/a">Seeds</a></li><li><a href="/b">Compost</a></li></ul></aside><footer>Contact us | Imprint</footer></body>""",
    "nested comments": """<div id="wrap"><div id="nav"><ul><li><a href="#">Start</a></li><li><a href="#">Archive</a></li></ul></div><div class="post"><h2>[[Why I sold my car]]</h2><p>[[It stood in the street for most of the year, and the street is short of room as it is.]]</p>
        <p>[[Since then I have taken the train, the bus and, on two occasions, a very old bicycle.]]</p></div><div class="share">Share this</div><ol class="comments"><li class="comment"><div>anna said:</div><p>I did the same last spring and I do not miss it at all, except when it rains.</p>
        <ul class="children"><li class="comment"><p>It rains a lot where I live.</p><ul class="children"><li class="comment"><blockquote><p>It rains a lot where I live.</p></blockquote><p>Buy a coat, then.</p></li></ul></li></ul></li></ol><div id="footer">Powered by a small blog engine</div></div>""",
    "notice and form": """<body><div class="cookie-banner"><p>We use cookies to understand how you use our site.</p><button>Accept</button></div><header><p>City Library</p><nav><ul><li><a href=/h>Hours</a></li><li><a href=/c>Catalogue</a></li></ul></nav></header>
        <section class="content"><h1>[[Summer opening hours]]</h1><p>[[In July and August the reading room opens at noon, and the children's room at ten.]]</p><ul><li>[[Monday to Friday: 12 to 18]]</li><li>[[Saturday: 10 to 14]]</li></ul><p>[[Books can be returned at any time through the flap beside the door.]]</p></section>
        <form><label>Your email</label><input><p>Get our newsletter every month.</p><button>Subscribe</button></form><footer><p>Privacy policy</p><p>&copy; City Library</p></footer></body>""",
    "figures and data": """<html><head><title>x</title><script>var p = "<p>no</p>";</script></head><body><article class="story"><h1>[[Harvest figures for the valley]]</h1><div class="byline">By Tom Fields</div><p>[[The wheat harvest was the largest since records began, though the price fell by a tenth.]]</p>
        <figure><img src=a.png><figcaption>[[A field near the river in late August.]]</figcaption></figure><table><tr><th>[[Year]]</th><td>[[Tonnes]]</td></tr><tr><td>[[2019]]</td><td>[[4,100]]</td></tr><tr><td>[[2020]]</td><td>[[5,250]]</td></tr></table>
        <p>[[Growers expect a smaller crop next year, as some land will lie fallow.]]</p></article><div class="ad">Cheap tractors, this week only!</div><div class="related"><h3>Related articles</h3><ul><li><a href=/x>Rain at last</a></li></ul></div><footer>Terms of use</footer></body></html>""",
    "german": """<body><div class="menu"><ul><li><a href=/>Startseite</a></li><li><a href=/k>Kontakt</a></li></ul></div><div class="text"><h1>[[Der alte Hafen wird saniert]]</h1><p>[[Die Stadt hat beschlossen, die Kaimauer bis zum Herbst zu erneuern, weil sie an drei Stellen nachgibt.]]</p>
        <p>[[W&auml;hrend der Arbeiten bleibt der Zugang &uuml;ber die Br&uuml;cke offen.]]</p><blockquote>[[&bdquo;Wir haben lange genug gewartet&ldquo;, sagte die B&uuml;rgermeisterin.]]</blockquote></div><div class="sidebar"><h3>Mehr zum Thema</h3><p>Newsletter abonnieren</p></div><div class="footer">Impressum Datenschutz</div></body>""",
    "body alone": """<html><body><h1>[[Notes on bread]]</h1><p>[[Flour, water, salt and time: nothing else is needed, and time is the one that most people leave out.]]</p><p>[[Mix the dough in the evening and bake it the next day.]]</p><p>[[If the crust is pale, the oven was not hot enough.]]</p><hr><p><a href="/">Back to the list</a></p></body></html>""",
    "short news": """<body><header class="masthead"><h1>The Daily Note</h1></header><nav><a href=1>Politics</a><a href=2>Culture</a></nav><main><article><h1>[[Bridge reopens early]]</h1><p>[[The bridge on Mill Lane opened to traffic this morning, two weeks ahead of time.]]</p><div class="ad-slot">Sponsored: new shoes</div>
        <p>[[Drivers are asked to keep to thirty until the markings are dry.]]</p></article></main><section class="comments"><h3>2 comments</h3><div class="comment"><p>About time too.</p></div><div class="comment"><p>They still have not mended the lights there.</p></div></section><footer><p>&copy; The Daily Note</p></footer></body>""",
}
