"""Sentences judged by hand, on which the residue classifier is measured.

They were written apart from the label rules and the contrast sentences, and
neither training nor labels use them.
"""

CASES = (
    "We're having trouble reaching this page right now.", "HTTP/1.1 504 Gateway Time-out", "401 Unauthorized", "nginx: 502 Bad Gateway", "The file you are looking for has been removed or renamed.", "Your session timed out.", "You don't have permission to access /private/ on this server.", "Forbidden", "Oops! That page can't be found.", "Server Error (500)",
    "An unexpected error has occurred while loading the chapter.", "Please log in again to read on.", "Please turn on JavaScript and reload the page.", "This page needs JavaScript to show its maps.", "JavaScript must be enabled in order for you to use this site.", "Scripts are blocked by your browser.", "Bitte erlauben Sie JavaScript.", "Diese Seite ist nicht verfügbar.", "Le serveur ne répond pas, le service est indisponible.", "El servidor no está disponible.",
    "Lorem ipsum dolor sit amet, consetetur sadipscing elitr.", "Vestibulum ante ipsum primis in faucibus orci luctus et ultrices.", "This is placeholder text.", "Your description goes here.", "Coming soon!", "TODO: fill in the history of the school", "lkjh asdf qwer poiu zxcv lkjh asdf", "text text text text text text text text", "foo foo foo foo foo foo foo foo foo foo",
    "Hi {{ user.name }}, welcome back to {{ shop }}!", "Kind regards, %(sender)s", "Founded in ${year} by ${founder}, the club has {members} members.", "The museum of [YOUR CITY] opens at [INSERT HOUR].", "Author: <<AUTHOR>>", "Posted on @@DATE@@ in @@SECTION@@", "__TITLE__", "<%= page_title %>", "Price: {{price}}", "Leiter der Schule ist {leiter}.", "El alcalde de {{ciudad}} es {{alcalde}}.",
    "undefined, undefined", "By null on null", "Category: undefined", "Mr None was mayor of None from None to None.", "Hello [object Object]!", "The tower is NaN metres high and stands in NaN.", "Name: ______  Town: ______",
)
PROSE = (
    "The letter was never found, and the heirs sold the house.", "A 503 tells the client to wait before it calls again.", "Room 404 of the hotel is on the fourth floor.", "The editor explained that “Access denied” had puzzled many subscribers.", "The phrase \"Page not found\" became the name of a band in Turin.", "Visitors with JavaScript turned off saw a plain list in the test of 2014.", "The bakery could not serve bread that day because the oven was broken.",
    "Lorem ipsum was set in many type books after 1960, long before computers.", "Compositors speak of dummy text when they mean words that nobody is meant to read.", "Cicero's De finibus is the source from which lorem ipsum was cut.", "In Mustache, {{ name }} is a variable, and the library fills it in.", "Bash replaces ${HOME} with the folder of the user.", "The letter has a blank, [name], that clerks completed by hand in 1911.", "Python formats %(count)d as a number when the string is applied.", "The braces in {title} belong to the syntax and do not show.",
    "He replied that None was a fine surname and Null a better one.", "A null hypothesis is rejected when the value is rare.", "The parser turns an empty cell into NaN, and a later step drops it.", "In JavaScript, undefined and null are two different things.", "She wrote [sic] after every odd spelling in the letters.", "See [3] and [12] for the census of the parish.", "Let A = {x | x < 7}; then the mean of A is 3.", "f(x) = \\frac{x}{2} + \\sqrt{x}", "while (i < n) { sum += a[i]; i++; }", "print(\"done\", file=sys.stderr)",
    "2022-07-14 09:31:08,512 [WARNING] pool: 3 of 8 workers busy", "2020-02-02T02:02:02Z [ERROR] id=77 code=12 took_ms=9.1", "<b>Bold</b> and <i>italic</i> are the tags that most editors know.", "[[Kiel|the port]] is how a wiki writes the link.", "{\"run\": 7, \"loss\": 0.25, \"tags\": [\"a\", \"b\"]}", "| mill | 1820 | 14 |", "The servers of the inn were paid in beer until 1890.", "Access to the tower is by a stair of 212 steps.", "Please was the only word that the parrot knew.",
    "Sorry business is what the islanders call the week of mourning.", "The page of the duke carried the lamp.", "A script of 90 pages was found in her desk.", "Das Schild „Zutritt verboten“ hing dort bis 1970.", "L'accès au phare fut refusé aux visiteurs pendant la guerre.", "El texto de la placa fue escrito por un maestro de la villa.", "Der Schlüssel wurde nie gefunden, und das Tor blieb zu.", "Who was denied access to the harbour in 1842?", "Of the 90 requests, 12 were refused by the council.", "Type designers test a page with sample words before they cut the metal.", "The crawler counts pages that return 404 and drops them from its list.", "Test pilots signed in at the gate and logged each flight.", "The river is not found on older maps.",
)
