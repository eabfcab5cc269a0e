"""Small labelled pages: an element with `data-main` opens main text, one with `data-other` what is not."""

PAGES = (
    # an article between menu, advert and footer
    """<html><head><title>River news</title></head><body><nav data-other><ul><li><a href="/">Home</a></li><li><a href="/w">World</a></li></ul></nav>
    <div class="ad" data-other>Buy two pairs of boots and get a third pair for half of the price today.</div>
    <article data-main><h1>The river rose</h1><p>The river rose by a metre in the night and people left the lower streets before dawn.</p><p>Yes.</p>
    <p>Nobody was hurt, the mayor said, and the bridge stays closed until the water falls again.</p></article>
    <footer data-other>&copy; River news. All rights reserved, and see our <a href="/t">terms</a>.</footer></body></html>""",
    # comments, related links, share buttons, a form and an advert inside the article
    """<body><header data-other><div class="logo"><a href="/">Daily Lamp</a></div><p>News for the whole valley, every day of the week.</p></header>
    <main><article data-main><h2>Bread prices</h2><p>Bread costs more than it did last spring, and bakers expect that flour will stay dear.</p>
    <p>See also <a href="/a">our table of prices for every town</a>.</p><p>Short.</p><blockquote>We bake less now, one of them told us.</blockquote>
    <div class="advertisement" data-other>Lamps for every room of your house, delivered in a day.</div>
    <div class="share-buttons" data-other><a href="#">Share</a> <a href="#">Send</a></div>
    <p data-main>Mills in the north still sell at the old price for a while, but their stores are running low.</p>
    <ul data-main><li>Rye went up by a tenth.</li><li>Wheat.</li></ul>
    <form data-other><label>Your address</label><p>Get a letter from us each week with the best stories.</p><button>Sign up</button></form>
    <section class="comments" data-other><h3>Two comments</h3><div class="comment"><p>I do not believe a word of this, my baker has not changed his prices at all.</p></div><div class="comment"><p>Same here.</p></div></section>
    </article></main><aside data-other><h3>Most read</h3><p>A fire broke out in the old mill, and no one knows who saw it first.</p><ul><li><a href="/1">The old mill burns</a></li></ul></aside>
    <footer data-other><p>Daily Lamp is printed in the valley by a house that was founded long ago.</p></footer></body>""",
    # no article element: content by class
    """<body><div id="header" data-other><h1><a href="/">Garden pages</a></h1><p>All about beds, seeds and tools for the garden.</p></div><div class="menu" data-other><a href="/s">Seeds</a> <a href="/t">Tools</a></div>
    <div id="content"><div class="post" data-main><h2>When to sow peas</h2><p>Sow peas once the soil is warm enough to touch, and cover them with a finger of earth.</p><p>Water well.</p>
    <p>Birds like the young shoots, so a net helps during the first weeks.</p></div></div>
    <div class="sidebar" data-other><h3>About</h3><p>This page is written by a gardener who has grown peas for a very long time.</p></div>
    <div class="cookie-notice" data-other>We use cookies so that the page works and to count our readers. Do you agree?</div>
    <div class="footer" data-other>Copyright by the gardener. Made with care.</div></body>""",
    # no hints at all: long plain blocks are the text, lists of links and notes at the edge are not
    """<body><div data-other><a href="/1">One</a></div><div data-other><a href="/2">Two</a></div><div data-other><a href="/3">Three and more</a></div>
    <div data-main><p>A plain page holds one long paragraph after another, and each of them speaks of the same thing for a good while.</p>
    <p>The second paragraph goes on where the first one stopped, with many words and without a single link in between them.</p>
    <p>It ends here.</p><p>The last paragraph is long again, so that nobody can take it for a line of a menu or a note at the foot.</p></div>
    <div data-other><a href="/p">Previous page</a> <a href="/n">Next page</a></div><div data-other>&copy; the writer</div></body>""",
    # an article whose own header holds its title; teasers of other articles in a sidebar
    """<body class="has-sidebar"><div class="wrapper"><article data-main><header><h1>Stars over the hill</h1></header><p>On clear nights the hill is full of people who look at the sky with tubes and maps.</p>
    <figure><figcaption>The hill at night.</figcaption></figure><p>They stay until morning.</p><table><tr><td>Star</td><td>Seen at ten</td></tr></table>
    <footer data-other>Filed under <a href="/sky">sky</a></footer></article>
    <aside class="side" data-other><article><h4>Moon rises late</h4><p>The moon rises late this month and leaves the evening dark for those who watch.</p></article></aside></div></body>""",
    # notices and a dialog around the main part
    """<body><div role="banner" data-other><p>Welcome to the library of the town, open every day but one.</p></div><div role="dialog" class="modal" data-other><p>Please tell us what you think of the new rooms.</p></div>
    <div class="alert" data-other>The reading room is closed on the first of the month.</div><div role="main" data-main><h1>How to borrow</h1><p>Show your card at the desk and take the books home for up to four weeks.</p><p>Ask us.</p>
    <p><a href="/rules">The full rules of the library</a></p></div><div role="navigation" data-other><ul><li><a href="/h">Hours</a></li><li>Rooms</li></ul></div>
    <div role="contentinfo" data-other>Town library, Mill street, next to the old bridge over the river.</div></body>""",
    # a list of comments after the text, a newsletter box and related stories by class
    """<body><div class="nav-bar" data-other>Start</div><div class="entry-content" data-main><p>The ferry runs again. It carries cars on two days and people on all others.</p><p>Tickets are sold on board.</p><h2>Times</h2><p>From six.</p></div>
    <div class="related" data-other><h3>Related</h3><p>The old ferry was sold to a man who wants to turn it into a house.</p></div><div class="newsletter" data-other><p>Read the harbour letter each week and know before all others.</p></div>
    <ol class="comment-list" data-other><li><p>At last! I had to drive round the whole bay for two years.</p></li><li>Good.</li></ol></body>""",
    # long blocks in menus, adverts, sidebars, comments and footers; short ones in the article
    """<body><nav data-other><p>This menu leads to all parts of the paper, from the first page with the news of the day to the last one with the weather, and to letters from our readers.</p></nav>
    <div class="ad" data-other>Our shop has chairs, tables, lamps and beds for every room of the house, and whoever buys one of them before the end of the month pays for it only in the next year.</div>
    <article data-main><h1>Rain</h1><p>Rain.</p><p>It rained.</p><p><a href="/r">Rain map</a></p><p>It will rain again</p><p>Copyright is what our writers keep.</p></article>
    <div id="comments" data-other><p>I have lived here for a very long time and I can say that it never rained as much as in the year when the old bridge went down the river with two carts on it.</p><p>Right you are.</p></div>
    <div class="sidebar-left" data-other><p>The writers of this paper live in the valley themselves, walk its roads every day, and know most of the people whose stories they tell in these pages.</p></div>
    <aside data-other><p>Whoever wants to write for this paper can send us a page of text, with a name and an address, and will hear from us within the first two weeks of the month.</p></aside>
    <footer data-other>&copy; The paper of the valley, printed and sold by the house at the mill. No part of it may be copied, read aloud or put on other pages without a letter from the house that allows it.</footer></body>""",
    # plain pages: notes and menus without hints round long text
    """<body><p data-other><a href="/">Start</a> | <a href="/map">Map</a> | <a href="/help">Help</a></p><div data-main><h2>On walls</h2><p>A dry wall is built of flat stones that are laid without any mortar, and it stands for a hundred years if its foot is wide enough.</p>
    <p>Frost moves it a little, and so every spring some of the stones have to be put back where they came from, which is slow but easy work.</p></div><p data-other>Copyright the mason</p></body>""",
    """<body><table data-other><tr><td><a href="/a">Birds</a></td></tr><tr><td><a href="/b">Trees and shrubs</a></td></tr></table><div data-main><p>The owl sleeps by day in hollow trees, and in the night it hunts for mice over the fields next to the wood, flying without a sound.</p>
    <p>Its young ones stay in the nest for a month, and they are fed there by both of their parents until they can fly themselves.</p></div><p data-other><a href="/o">More on owls</a></p></body>""",
    # pages cut off inside the text
    """<body><nav data-other><a href="/">Start</a></nav><article data-main><h1>Snow</h1><p>It snowed.</p><p>And then""",
    """<body><div class="menu" data-other><a href="/">Start</a></div><main data-main><p>Ice</p>""",
    """<body><div data-main><p>The lake froze over in the first week of the year, and for the first time in ten years the children could walk to the island.</p><p>Some of them""",
    # tables as layout and no hints: cells with links or a few words at the edges, long cells as text
    """<body><table><tr><td data-other>Mill gazette</td><td data-other>Monday</td></tr><tr><td data-other><a href="/n">News</a><br><a href="/s">Sport</a><br><a href="/w">Weather</a></td>
    <td data-main><p>The old mill at the foot of the hill will grind again from next week on, after nine years in which nobody turned its wheel.</p><p>So it was said.</p>
    <p>Its new owner has cut the boards himself, and the stones come from the same quarry as those of two hundred years ago.</p></td></tr><tr><td data-other>Printed in the valley</td></tr></table></body>""",
    """<body><div data-other>Harbour board</div><div data-other><a href="/t">Tides</a> <a href="/b">Boats</a> <a href="/c">Crews</a></div><div data-other>You are here: <a href="/">board</a></div>
    <div data-main>The tide came in higher than on any other day of the year, and the boats at the outer wall had to be tied up twice.<br>Two of them were lost.</div>
    <div data-main>By noon the water had gone down far enough for the crews to walk out and look for their nets on the sand.</div><div data-other>Call the board</div></body>""",
    # lists of links with long titles are no text, even where every one is a sentence
    """<body><div data-main><h2>Bees in winter</h2><p>Bees do not sleep in winter, they sit close together in the hive and shiver, so that the queen in their middle stays warm.</p>
    <p>A hive eats some twelve pounds of honey from the first frost to the day when the willows bloom.</p></div>
    <div data-other><p><a href="/1">How a keeper from the next valley lost all of his hives in a single night of frost</a></p><p><a href="/2">Why the honey of this year is darker than that of the last one and what it has to do with rain</a></p>
    <p><a href="/3">Ten plants that bees like more than all others, and where to put them</a></p></div></body>""",
    # a long text with links in it stays, a line with more links than words around them goes
    """<body><div data-other><a href="/a">A</a> to <a href="/z">Z</a></div><div data-main><p>The word for <a href="/bread">bread</a> is older than that for <a href="/butter">butter</a>, as people baked long before they kept cows, and both were known before anyone wrote.</p>
    <p>In <a href="/north">the north</a> the two words sound nearly the same today, which has led many a traveller to a dry breakfast.</p></div><div data-other>See <a href="/1">loaf</a>, <a href="/2">crust</a>, <a href="/3">crumb</a></div></body>""",
    # short lines: between long ones they are text, beside links or at the edge they are not
    """<body><p data-other>Old roads</p><p data-other><a href="/m">Map of all roads</a></p><div data-main><p>The salt road crosses the pass at its lowest point and then follows the stream down to the lake, where the barges waited.</p><p>Nine days.</p>
    <p>That was the time a mule took from the sea to the lake with two sacks of salt on its back and a third on its driver's.</p><p>No more, no less.</p>
    <p>When the tunnel was opened the road fell asleep, and grass has grown over all but a few of its stones since then.</p></div><p data-other><a href="/next">The wine road</a></p><p data-other>Page nine</p></body>""",
    """<body><div data-other>Weather desk</div><div data-other><a href="/h">Hourly</a></div><div data-main><p>Wind from the west brings rain in the early morning, which turns to snow above the tree line before it stops at about ten.</p><p>Then sun.</p>
    <p>In the evening the clouds come back, though they stay high, and the night will be the coldest of the week so far.</p></div><div data-other><a href="/d">Daily</a></div><div data-other>Desk open</div></body>""",
    # one block of text is a whole article
    """<body><div data-other><a href="/">Inn</a> <a href="/rooms">Rooms</a></div><div data-main>The inn has stood at the crossing since the war of the two dukes, and its sign shows both of them at one table, though it is not known that they ever met.</div><div data-other><a href="/book">Book a room</a></div></body>""",
    """<body><h1 data-other>Shop</h1><div data-other><a href="/1">Ropes</a></div><div data-other><a href="/2">Hooks</a></div><div data-main>Ropes of hemp have to be dried after every use and hung up in the loft, or they rot from the inside and break without a warning.</div><div data-other><a href="/3">Basket</a></div></body>""",
    # the whole page in a form, as some servers write it
    """<body><form data-other><div><a href="/in">Log in</a></div><article data-main><h1>Market day</h1><p>Stalls open at six.</p><p>Whoever comes late finds only cabbage.</p></article><input><div>Send us your opinion of the market, in a few words or in many, by the end of the week.</div></form></body>""",
    # reader comments as articles, and names that tell what stands beside
    """<body class="has-comments"><div class="layout-with-sidebar"><div class="post-body"><div class="entry" data-main><p>Chestnuts are ready when they fall.</p><p>Pick them up before the deer do.</p></div></div>
    <div class="comments" data-other><article><p>The deer in our wood have never touched a chestnut, whatever you say, and I have watched them for years.</p></article><article><p>Mine do.</p></article></div>
    <p class="advert" data-other>Baskets for chestnuts, apples and nuts, all of them woven by hand.</p></div></body>""",
    """<body><article data-main><h1>Glass</h1><p>Glass is sand that forgot.</p><p id="cookie-notice" data-other>This page keeps cookies for a year unless you tell it not to.</p><p data-main>It flows, but slowly.</p></article><p data-other>Another page of ours tells how to cut glass with a wheel, with oil, or in a bath of cold water.</p></body>""",
    # short marked notes between long blocks of the text
    """<body><div class="post" data-main><p>Snow fell on the upper farms for three days, and the road to the last of them was closed until the plough came up on the fourth.</p><p class="ad" data-other>Shovels, cheap.</p>
    <p data-main>The cows had to be milked by hand, as the lines were down, and most of the milk was given to the pigs or made into cheese.</p><div class="share" data-other>Tell a friend</div>
    <p data-main>On the fifth day the sun came out, and by the evening the first of the roofs were bare again and the gutters ran over.</p><p class="notice" data-other>Page moved.</p>
    <p data-main>Nobody was hurt, though a barn fell in at the crossroads, and an old man spent two nights with his neighbour's sheep.</p><aside data-other>Snow in numbers</aside>
    <p data-main>The next snow is not far, say the people who have lived there long enough to know it by the smell of the air.</p><div class="advertisement" data-other>Warm boots for all</div>
    <p data-main>They have stacked more wood this time, and the plough has been moved to the upper village for the rest of the winter.</p><div class="newsletter" data-other>Get our letter</div>
    <p data-main>Its driver has been given a room at the inn, which he says is warmer than his own house at the lower end of the valley.</p></div></body>""",
    """<body><div data-main><p>The quarry was left to the birds when the last of the slate had been cut, and within ten years a lake had filled it to the brim.</p></div><div class="promo" data-other>Slate for roofs</div>
    <div data-main><p>Divers come to it from far away, for the water is so clear that one can see the rails and the carts on the ground from a boat.</p></div><form data-other><p>Ask us anything</p></form>
    <div data-main><p>There is a crane as well, which still holds a block of slate in its hook, forty feet below the keel of whoever rows across.</p></div><div class="related" data-other>Other lakes</div>
    <div data-main><p>It has been there since a Friday, the men say, when the whistle blew and they went home to come back on a Monday that never was.</p></div></body>""",
)


def articles() -> list[str]:
    """Labelled articles whose blocks have every neighbourhood: titles, bylines, short lines, long paragraphs and lines of links, each before and after each other; and plain pages of links and text."""
    words = ("stone mill road water field north winter bread house light river evening market letter garden cloud bridge summer valley harvest " * 3).split()
    line = lambda n: " ".join(words[:n])
    kinds = [line(1), line(3), line(8), line(20), line(60), f'<a href="/x">{line(2)}</a>', f'<a href="/x">{line(12)}</a>', f'{line(4)} <a href="/x">{line(4)}</a>']
    out = []
    for i, first in enumerate(kinds):
        for second in kinds:
            third = kinds[(i * 3 + kinds.index(second)) % len(kinds)]
            body = "".join(f"<p>{x}</p>" for x in (first, second, third))
            out.append(f'<body><nav data-other><p>{second}</p></nav><article data-main>{body}</article><footer data-other><p>{first}</p></footer></body>')
    # without marks, a short line between lines of links goes and one between lines of text as long stays
    for n in (12, 18, 25, 40):
        linked = f"<p><a href='/y'>{line(n)}</a></p><p>{line(3)}</p>" * 3
        out.append(f"<body><div data-other>{linked}<p><a href='/z'>{line(n)}</a></p></div><div data-main>{f'<p>{line(n)}</p><p>{line(3)}</p>' * 3}<p>{line(n)}</p></div></body>")
    return out
