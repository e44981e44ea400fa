"""A small labelled table of urls for the url filter, written by hand from general knowledge of such hosts.

Neither the hosts nor the paths are taken from any data set. Names in ``_NEUTRAL`` are made of random letters.
"""

from __future__ import annotations

import random

_BAD = """
best-online-casino.com royal-casino-bonus.net casino777.biz playcasinoslots.info vegas-casino-jackpot.com casinobonus24.net luckyslots.club slotmachines-online.com megaslots777.net jackpot-slots.org
pokerstars-bonus.info texas-poker-room.com onlinepokerfree.net videopoker-win.biz betting-odds-tips.com sportbets365.net bet-on-football.biz livebetting.club bettingbonus.info freebet-codes.com
sure-bets-today.com roulette-system.net blackjack-online.biz bingo-bonus.com gambling-sites-review.com onlinegambling.biz gamblersparadise.net lotto-winner.biz lottery-jackpot-win.com scratchcards-win.net
buy-viagra-online.com viagra-discount.biz cialis-generic.net cheapcialis.info levitra-pharmacy.com canadian-pharmacy-rx.com onlinepharmacy-noprescription.net rx-pills-cheap.biz dietpills-store.com pills-online-shop.net
weightlosspills.info miracle-diet-pills.com steroids-for-sale.biz buyxanax.net tramadol-cheap.com male-enhancement-pills.net drugstore-discount-meds.com cheap-meds-online.biz genericpills.org hghsupplements.biz
free-porn-videos.com pornhubfree.net hotpornmovies.biz porntube-hd.com xxxvideos-free.net xxx-movies.biz xxxcams.live sexcams-live.com livesexchat.net adultfriend-dating.biz
adult-movies-free.com adultvideos.xxx adultcontent-hd.net hardcore-sex.biz sexy-girls-nude.com nudepics.net nude-celebs-leaked.biz milf-porn.xxx teens-xxx.net escort-girls-city.com
escorts-vip.net erotic-massage-escort.biz hot-singles-nearby.com hookup-tonight.net camgirls-nude.live onlyfans-leaks-free.com fetish-porn.net hentai-xxx.biz bigtits.xxx sexshop-toys-cheap.biz
payday-loans-fast.com instant-payday-loan.net quickloans-badcredit.biz cash-advance-now.com badcredit-loans.info fastcash-loan.net no-credit-check-loans.biz debt-relief-free.com consolidate-loans-cheap.net easy-cash-online.biz
get-rich-quick-system.com make-money-fast.biz earn-money-from-home.net workathome-cash.info bitcoin-doubler.biz crypto-doubler.net free-bitcoin-giveaway.com crypto-profit-bot.biz forex-robot-profit.com binaryoptions-signals.net
replica-watches-rolex.com fakerolex.biz replicahandbags-cheap.net cheap-louis-vuitton-outlet.com discount-ugg-boots.biz fake-ids-online.com counterfeit-money.biz cheap-jerseys-wholesale.net rolex-replica-store.com replica-shoes.biz
win-free-iphone.com claim-your-prize-now.net free-giftcards-generator.com you-are-winner.biz freeprizes.club congratulations-winner.info survey-reward-win.net free-robux-generator.com prize-claim.biz giveaway-winner.net
crack-keygen-download.com serialkeys-free.net windows-activator-crack.com warez-downloads.biz full-version-crack.net cracked-software.biz nulled-scripts.com keygen-serials.net apk-mod-hack.com game-cheats-hacks.biz
torrent-movies-free.com freemovies-stream-hd.net watch-movies-free-online.biz piratemovies-torrent.org mp3-downloads-free.biz torrentz-mirror.net pirate-proxy-torrents.com streamfree-sports.biz dvdrip-torrents.net free-ebooks-warez.com
malware-downloads.ru virus-scan-alert.com your-computer-infected.net free-antivirus-download.biz trojan-remover-free.com flash-player-update-now.com codec-download-required.net driver-update-free.biz pc-speedup-cleaner.com system-alert-warning.info
paypal-login-verify.com secure-bank-login-update.net account-verification-required.com appleid-confirm-login.net phishing-kit.biz signin-secure-verify.info bank-account-update.biz confirm-your-account.net webmail-login-verify.com password-reset-alert.info
cheap-seo-backlinks.com buy-backlinks.biz seo-link-building-cheap.net linkfarm-directory.com spamlinks.biz spammy-links.net bulk-email-spam.com massmailer-spam.net spam-bot-service.biz article-spinner-seo.com
buy-followers-likes.com buyinstagramfollowers.net cheap-traffic-hits.biz traffic-exchange-hits.com autosurf-clicks.net get-paid-to-click.biz paidclicks.net clickbank-profits.biz guestbook-spam.net link-exchange-farm.info
adserver-popup.com popunder-ads.net ads-network-click.biz adclick-server.com banner-ads-exchange.net tracking-pixel-ads.com adtracker.net clicktracker-redirect.biz popads-serve.com trackingserver.net
ad-tracking-click.com ads.doubleserve.net tracker.adnetwork.biz adsyndicate.com track-visitors-ads.net popup-advertising.biz redirect-click-ads.com toolbar-adware.net adware-install.biz spyware-toolbar.com
psychic-love-spells.biz miracle-cure-cancer.com lose-weight-fast-now.net detox-tea-slim.biz penis-enlargement.com breast-enhance.biz hairloss-miracle.net anti-aging-secret.biz essay-writing-cheap.com buy-essays-online.net
free-ringtones-download.com cheap-viagra-pills.info betonline-casino.net pokies-casino.biz slots-bonus-free-spins.com spin-win-bonus.net free-spins-casino.club bonus-codes-bets.com casino-poker-bets.net adult-dating-sex.com
""".split()

_GOOD = """
www.cambridge-university.ac.uk library.oxford.edu physics.berkeley.edu math.princeton.edu cs.stanford.edu law.columbia.edu medicine.yale.edu www.uni-heidelberg.de www.sorbonne-universite.fr www.unam.mx
www.citylibrary.org nationalmuseum.se www.britishlibrary.uk museum-of-modern-art.org artgallery.nsw.gov.au historymuseum.org science-museum.org.uk archive.org folger.edu maritime-museum.nl
www.morningnews.com dailyherald.com theguardian.com www.lemonde.fr elpais.com www.zeitung-online.de localnews.net weeklygazette.org evening-post.com worldreport.org
public-radio.org radio4.co.uk broadcast-news.tv weather.gov www.weather-forecast.org climate.nasa.gov meteo.fr wetterdienst.de marineforecast.net earthquake.usgs.gov
en.wikipedia.org wiki.archlinux.org docs.python.org developer.mozilla.org kernel.org gnu.org apache.org debian.org stackoverflow.com openbsd.org
opensource-project.org code-review.dev api-docs.io programming-tutorials.com learn-programming.org compiler-explorer.com datascience-notes.net linux-questions.org javascript-guide.dev rust-lang.org
cooking-recipes.com bread-baking.org grandmas-kitchen.net vegetarian-recipes.com soup-and-salad.com wine-and-cheese.fr coffee-roasters.com teahouse.co.uk seriouscooking.com spice-market.net
gardening-tips.org botanic-garden.org rose-society.org birdwatching.net wildlife-trust.org.uk national-park.gov mountain-hiking.com alpine-club.ch forestry-commission.org butterfly-conservation.org
travel-notes.net backpacking-europe.com railway-timetable.org bus-schedules.net airport-information.com hotel-garni.at hostel-lisboa.pt city-guide-berlin.de camping-bretagne.fr visitscotland.com
hospital-saintmary.org children-hospital.org dental-clinic.de health-service.nhs.uk nursing-college.edu public-health.gov cancer-research.org heart-foundation.org pharmacology-journal.org vaccination-info.gov
parliament.uk bundestag.de senate.gov city-council.gov.uk county-court.gov statistics-office.org census.gov tax-office.gov.au ministry-education.fr embassy.org
primary-school.edu highschool-alumni.org kindergarten-sonne.de language-school.com math-lessons.org chemistry-lectures.edu onlinecourse.edu teachers-union.org student-union.ac.uk education-portal.org
poetry-foundation.org bookreview.com literature-club.org shakespeare.mit.edu classic-novels.net publishers-weekly.com bookshop.org writers-guild.org gutenberg.org philosophy-papers.org
football-club.co.uk cycling-federation.org tennis-association.com swimming-club.net chess-club.org running-magazine.com olympics.com hockey-league.ca rowing-regatta.org cricket-world.com
classical-music.com jazz-archive.org symphony-orchestra.org opera-house.at film-review.net cinema-history.org theatre-company.org photography-forum.net guitar-lessons.com folkmusic.ie
personal-blog.net johnsmith-blog.com family-history.org genealogy-society.org woodworking-forum.com knitting-patterns.net model-railways.org amateur-radio.net vintage-cars.com motorcycle-repair.com
insurance-company.com savings-bank.de credit-union.org accounting-firm.com real-estate-agency.com architecture-office.ch engineering-company.com furniture-shop.com bicycle-store.nl hardware-store.com
labor-union.org red-cross.org charity-trust.org.uk church-of-england.org monastery.org community-center.org animal-shelter.org fire-department.gov police.uk volunteer-network.org
astronomy-picture.org geology-society.org quantum-physics.edu neuroscience-lab.org marine-biology.edu mathematics-stackexchange.com statistics-journal.org chemistry-world.com plantscience.org space-agency.int
tribune-sentinel.com journal-of-history.org village-hall.org.uk river-trust.org stadtbibliothek.de universidad-salamanca.es ayuntamiento.es mairie-lyon.fr biblioteca-nacional.es volkshochschule.de
accounts-department.edu trackandfield.org betterbusiness.org alphabet-books.com advent-calendar.de addiction-counselling.org spinning-wheel.net winter-sports.at cashmere-knitwear.co.uk links-golf-club.com
essex-council.gov.uk sussex-university.ac.uk analysis-institute.org winchester-cathedral.org.uk credit-history-law.edu loanwords-linguistics.edu serial-killers-novels.com hacking-conference.org clickers-classroom.edu adopt-a-dog.org
""".split()

_PATHS = ("/", "/index.html", "/about", "/en/page.html", "/2019/03/title-of-story", "/articles/12345", "/p?id=7", "/download.php")


def _neutral(n: int, seed: int = 20) -> list[str]:
    r = random.Random(seed)
    part = lambda: r.choice("bcdfghjklmnprstvwz") + r.choice("aeiou") + r.choice(("", "", r.choice("lmnrst")))
    return ["".join(part() for _ in range(r.randint(2, 4))) + r.choice((".com", ".org", ".net", ".de", ".fr", ".io", ".example", ".example.com", ".example.org")) for _ in range(n)]


def names() -> list[tuple[str, int]]:
    """(host, 1 to block): bad, good and neutral ones; neutral names (random letters) are no reason to block."""
    return [(h, 1) for h in _BAD] + [(h, 0) for h in _GOOD] + [(h, 0) for h in _neutral(300)]


def rows(hosts: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """(url, 1 to block): each host under a few paths and end names, so that these say nothing."""
    out = []
    for k, (host, label) in enumerate(hosts):
        stem = host.rsplit(".", 1)[0]
        for j, h in enumerate((host, "www." + host.removeprefix("www."), stem + (".com", ".org", ".net")[k % 3], stem + (".example.com", ".example.org")[k % 2])):
            out.append((f"http://{h}{_PATHS[(k + j) % len(_PATHS)]}", label))
    return out + [("", 0)] * (len(out) // 4)  # without evidence: allow


def builtin_labelled() -> list[tuple[str, int]]:
    return rows(names())
