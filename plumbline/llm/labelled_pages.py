"""A small fixed set of labelled pages, written for this library: [[ and ]] enclose the main text.

Layouts of many kinds: news, weblogs, manuals, forums and plain old pages, with telling names and without any, with short and
long paragraphs, lists and tables in the text, adverts and boxes amid it, and comments that read like text.
"""

_SENTENCES = [
    "The river rose again last night and the keepers of the lower lock opened both gates before the morning boats came down.",
    "Nobody had seen such a flood in years.",
    "Three of them stayed until noon, when the water had fallen by a hand, and wrote down what they had measured at each of the four posts.",
    "It was cold.",
    "Later the mayor said that the old walls would be raised, that the money had been found, and that work could begin before the winter if the weather held.",
    "What remains to be seen is who pays for the bridge?",
    "Barges waited above the weir, and their crews played cards in the inn.",
    "A second report, which the council had asked for in spring, came to much the same result and was put away in a drawer.",
]


def _say(begin: int, count: int) -> str:
    return " ".join(_SENTENCES[(begin + i) % len(_SENTENCES)] for i in range(count))


def _text(lengths: str, wrap: str = "p", begin: int = 0) -> str:
    """Paragraphs of as many sentences as the digits say; every third one has links, every fourth bold words."""
    said = [_say(begin + 3 * i, int(n)) for i, n in enumerate(lengths)]
    said = [x.replace("river", "<a href='/r'>river</a>").replace("the water", "<a href='/w'>the water</a>") if i % 3 == 0 else x for i, x in enumerate(said)]
    said = [x.replace("came", "<b>came</b>").replace("cold", "<em>cold</em>") if i % 4 == 1 else x for i, x in enumerate(said)]
    return "".join(f"<{wrap}>[[{x}]]</{wrap}>" for x in said)


def _links(*names: str, wrap: str = "li") -> str:
    return "".join(f"<{wrap}><a href='/{i}'>{name}</a></{wrap}>" for i, name in enumerate(names))


_MENU = _links("Home", "World news", "Sport", "About us", "Contact")
_STORIES = _links("Flood warning lifted in the valley", "Ten boats you should see this summer", "Why the bridge was never built")

LABELLED_PAGES = [
    # News, with telling names.
    f"<body class='post-template page'><header class='site-header'><a href='/'>The Daily Lock</a><nav><ul>{_MENU}</ul></nav></header><main><article class='post entry'><h1>[[Lock gates opened]]</h1><p class='meta byline'>By our reporter</p>{_text('21312')}</article></main>"
    f"<aside class='sidebar'><h3>Most read</h3><ul>{_STORIES}</ul></aside><footer><p>All rights reserved by the daily lock company.</p><ul>{_links('Imprint', 'Privacy')}</ul></footer></body>",
    f"<div id='cookie-banner' class='cookie consent notice'><p>We use cookies to make this site better for you. By going on you agree to that.</p><button>Accept all</button></div><div class='menu nav'>{_MENU}</div>"
    f"<div id='content' class='content'><h1>[[The lower lock]]</h1>{_text('331')}<div class='ad advert sponsored'>Buy boats now and save a lot today.</div>{_text('24', begin=2)}</div>"
    f"<div id='comments' class='comments'><h2>Comments</h2><div class='comment'><p>{_say(1, 2)}</p></div><div class='comment reply'><p>So was I and it was not.</p></div></div><div class='footer'>Imprint and privacy</div>",
    # Names without meaning: tags, links and lengths have to tell.
    f"<div class='x1'><div class='x7'>{_links('Home', 'News', 'Shop', wrap='span')}</div><div class='x3'><h1>[[Water at the gates]]</h1>{_text('3211', 'div')}<ul><li>[[{_say(2, 1)}]]</li><li>[[{_say(3, 1)}]]</li></ul>{_text('14')}</div><div class='x9'><div>{_links(*'abcdef', wrap='span')}</div><div>Terms of use</div><div>Copyright the lock 2020</div></div></div>",
    f"<div>{_links('One', 'Two', 'Three', wrap='div')}</div><div>{_text('4')}<div>Advertisement</div>{_text('23', begin=5)}</div><div><div><a href='/t'>Terms of use</a> and <a href='/p'>privacy</a></div><div>Sign up for our letter</div></div>",
    f"<div><a href='/'>Lock</a></div><div>{_links('Top', 'New', 'Best', wrap='b')}</div><h2>[[Both gates]]</h2>{_text('12121')}<hr><div>{_STORIES}</div><div>Contact: the lock, high street</div>",
    # An old page of tables.
    f"<table><tr><td>{_links('Start', 'Guests', 'Links', wrap='p')}</td><td><font><h1>[[My river]]</h1>{_text('131')}<table><tr><th>[[Post]]</th><th>[[Height]]</th></tr><tr><td>[[one]]</td><td>[[two hands]]</td></tr><tr><td>[[two]]</td><td>[[three hands]]</td></tr></table>{_text('2')}</font></td></tr></table><center>Best seen at 800 by 600</center>",
    # A manual, with code, definitions and pictures.
    f"<header><div class='topbar'>{_links('Docs', 'Download', wrap='div')}<form class='search'><label>Search the manual</label><input name='q'><button>Go</button></form></div></header><nav class='toc'><ol>{_links('Begin', 'Locks', 'Gates')}</ol></nav><main class='main body'><h1>[[Working a gate]]</h1>{_text('21')}<pre>[[open gate; wait; close gate]]</pre><dl><dt>[[Gate]]</dt><dd>[[{_say(3, 1)}]]</dd></dl><figure><img><figcaption>[[The gate, seen from below.]]</figcaption></figure><h2>[[Care]]</h2>{_text('12', begin=4)}<blockquote>[[{_say(6, 1)}]]</blockquote></main><footer><div>Made with care.</div></footer>",
    # Boxes amid the text.
    f"<nav>{_MENU}</nav><article><header><h1>[[The flood, hour by hour]]</h1></header>{_text('2')}<aside class='promo pullquote'><p>Read more of this in our shop.</p></aside>{_text('31', begin=1)}<section class='related'><h3>Related stories</h3><ul>{_STORIES}</ul></section>{_text('22', begin=3)}<form class='poll'><p>What do you think of it?</p><select><option>Yes</option><option>No</option></select></form><div class='ad'>Sale of the week</div>{_text('1')}<div class='newsletter signup'><p>Get our letter every week by mail.</p></div>{_text('1')}<div class='advert sponsored ad'>Buy a boat today and pay next year.</div>{_text('12', begin=5)}</article><section><h2>Your views</h2><ol><li><p>{_say(2, 3)}</p></li><li><p>{_say(4, 2)}</p></li></ol></section><footer>&copy; the lock. {_say(1, 1)}</footer>",
    f"<header><p>{_say(1, 1)}</p></header><div>{_say(3, 1)}</div><article><h1>[[Down the river]]</h1>{_text('33211')}</article><div><p>{_say(0, 2)}</p></div><footer><p>{_say(6, 1)}</p></footer>",
    # A weblog without article or main.
    f"<div class='wrapper container'><div class='header banner'><h2>Notes from the lock</h2><p>A log of small things</p></div><div class='post entry-content text story'><h1>[[Mud]]</h1>{_text('112')}</div><div class='share social tags'><a href='#'>Share</a> <a href='#'>Post</a> Filed under water</div><div class='respond comments commentlist'><h3>2 replies</h3><p>{_say(2, 2)}</p><p>{_say(0, 1)}</p></div><div class='widget'><h3>Archive</h3><ul>{_links('May', 'June', 'July')}</ul></div></div>",
    f"<div role='navigation' class='navbar'>{_MENU}</div><div role='main'><div class='alert warning notice'>Please update your browser to see this page.</div><section>{_text('22', 'div')}<section>{_text('21')}</section></section></div><div class='pagination'><a href='?1'>1</a> <a href='?2'>2</a></div><div class='login register'>Log in or register to comment.</div>",
    # Lists as the text.
    f"<nav><div>{_MENU}</div></nav><main><h1>[[Five rules of the lock]]</h1><ol>{''.join(f'<li>[[{_say(i, 1 + i % 2)}]]</li>' for i in range(5))}</ol><p>[[That is all.]]</p></main><footer>{_links('Help', 'Jobs', wrap='span')}</footer>",
    # Names that mislead: only their elements' place and content tell.
    f"<div class='search-page header-fixed'><nav>{_MENU}</nav><article class='post meta comment-count'><h1>[[High water]]</h1>{_text('231')}</article><footer>About the lock</footer></div>",
    f"<div class='has-sidebar with-menu'><div class='menu'>{_MENU}</div><main class='share-top'>{_text('1321')}</main></div>",
    # Text-like paragraphs around the main element.
    f"<div><p>{_say(3, 1)}</p></div><main><h1>[[News]]</h1><h2>[[From the lock]]</h2>{_text('13')}<p>[[open | wait | close | wait]]</p><p>[[Open it]]</p>{_text('2')}</main><div><h3>Answers</h3><div><p>{_say(4, 2)}</p></div><div><p>{_say(0, 3)}</p></div><div><p>{_say(2, 1)}</p></div></div><div>{_say(1, 1)}</div>",
    f"<nav>{_MENU}</nav><div>{_say(6, 1)}</div><article><h1>[[A song]]</h1><p>[[Low water, high water]]</p><p>[[and never a boat]]</p><p>[[the | gate | stands | open | all | night]]</p><p><b>[[Refrain]]</b></p><p>[[Low water, high water]]</p></article><div><p>{_say(2, 2)}</p><p>{_say(5, 2)}</p></div><footer>{_say(0, 1)}</footer>",
    # Short ones.
    f"<p>[[{_say(3, 1)}]]</p>",
    "[[Plain words]]",
    f"<article><p>[[Short text]]</p><p>[[{_say(3, 1)}]]</p></article>",
    f"<nav><a href='/'>Home</a></nav><h1>[[Gate closed]]</h1><p>[[{_say(1, 1)}]]</p><footer>The lock</footer>",
    f"<h1>[[Notice]]</h1><p>[[{_say(5, 1)} <a href='/x'>{_say(3, 1)}</a>]]</p><div>{_links('Back', 'Home', wrap='span')}</div>",
    # Notices in elements without a name, before and behind the text.
    f"<div>We use cookies on this site. Read our cookie policy.</div><article><h1>[[Ice on the weir]]</h1>{_text('221')}</article><div>Copyright 2021 The Lock Company Ltd. All rights reserved. No part of this page may be copied without permission.</div>",
    f"<p>[[{_say(0, 2)}]]</p><p>[[{_say(4, 3)}]]</p><div>Copyright 2019 Weir Press. All rights reserved. Terms of use and privacy policy apply.</div>",
    f"<div>This site uses cookies. Accept cookies or change your cookie settings.</div><p>[[{_say(2, 2)}]]</p><p>[[{_say(6, 1)}]]</p><p>[[{_say(1, 3)}]]</p><p>Subscribe to our newsletter. Unsubscribe at any time.</p>",
    f"<h1>[[A new gate]]</h1><p>[[{_say(5, 2)}]]</p><div>Advertisement</div><p>[[{_say(3, 2)}]]</p><p>[[{_say(7, 2)}]]</p><div>Share this page: email, print, subscribe. Copyright, all rights reserved.</div>",
    f"<p>Sign in or register. Privacy policy, cookie policy and terms of use.</p><h2>[[Two boats]]</h2>{_text('132', 'div')}<p>Permission to reprint: copyright of the press, all rights reserved.</p>",
    # Forms amid and behind the text, and one around all of it.
    f"<article><h2>[[Low tide]]</h2><p>[[{_say(3, 1)}]]</p><form><label>Name</label><input><label>Mail</label><input><button>Send</button></form></article><section class='comments'><p>{_say(1, 1)}</p></section>",
    f"<main><p>[[{_say(5, 1)}]]</p><form class='signup'><label>Your name</label><select><option>Mr</option><option>Ms</option></select><button>Go</button></form><p>[[{_say(2, 1)}]]</p></main>",
    f"<nav>{_MENU}</nav><article><h1>[[At the weir]]</h1>{_text('12')}<form><label>Name</label><input><label>Town</label><input><p>Write to us</p><label>Text</label><button>Send</button></form></article>",
    f"<article><p>[[{_say(6, 2)}]]</p><p>[[Not much]]</p><form><label>x</label><label>y</label><label>go</label><span>or not</span></form><p>[[{_say(0, 1)}]]</p></article><footer>Imprint</footer>",
    f"<form id='page'><div>{_links('Start', 'Search', wrap='span')}</div><div id='main'><h1>[[Old gates]]</h1>{_text('22')}</div><div>Imprint</div></form>",
    # What reads like a notice, but stands amid the text.
    f"<nav>{_MENU}</nav><article><h1>[[The charter]]</h1>{_text('13')}<p>[[All rights reserved.]]</p>{_text('21', begin=4)}<p>[[Copyright of the charter, all rights reserved.]]</p></article><footer>Copyright 2020. Privacy and terms.</footer>",
    f"<header>{_links('Home', 'Log', wrap='span')}</header><article><p>[[Terms of use of the lock.]]</p>{_text('31')}<p>[[All rights reserved.]]</p></article><div>Cookie policy</div>",
    # Short lists as part of the text, or all of it.
    f"<main><h2>[[What to bring]]</h2><ul><li>[[Rope]]</li><li>[[Gloves]]</li><li>[[Lamp]]</li><li>[[Bread]]</li></ul></main><footer>{_links('Help', 'Terms', wrap='span')}</footer>",
    "<p>[[Bring with you:]]</p><ul><li>[[Oil]]</li><li>[[Rags]]</li><li>[[Paint]]</li></ul>",
    f"<nav>{_MENU}</nav><article><p>[[{_say(3, 1)}]]</p><p>[[You need:]]</p><ol><li>[[Spade]]</li><li>[[Bucket]]</li><li>[[Two boards]]</li></ol><p>[[{_say(1, 2)}]]</p><ul><li>[[Sand]]</li><li>[[Lime]]</li></ul></article><ul>{_STORIES}</ul>",
    f"<div><h3>[[Posts]]</h3><ul><li>[[North]]</li><li>[[South]]</li><li>[[Weir]]</li></ul>{_text('21')}</div><div>{_links('Imprint', 'Contact', 'Press', wrap='span')}</div>",
]
