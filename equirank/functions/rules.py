"""Institution rules: names that mark an affiliation, look-alikes, and hosts that are no institutions.

All are defaults; every operator takes its own tables of them.
"""

from __future__ import annotations

# Names of the top tier of a university ranking.
RANKED = [
    "massachusetts institute of technology", "mit", "imperial college london", "stanford university", "university of oxford",
    "harvard university", "university of cambridge", "california institute of technology", "caltech", "eth zurich", "ucl",
    "university college london", "national university of singapore", "nus", "university of hong kong", "hku",
    "nanyang technological university", "ntu", "peking university", "tsinghua university", "university of pennsylvania",
    "cornell university", "yale university", "chinese university of hong kong", "cuhk", "university of new south wales",
    "unsw sydney", "unsw", "johns hopkins university", "university of california berkeley", "uc berkeley",
]
# Names of the top tier of a computer-science ranking.
FIELD_RANKED = [
    "carnegie mellon university", "cmu", "university of illinois urbana-champaign", "university of illinois at urbana-champaign",
    "uiuc", "shanghai jiao tong university", "sjtu", "university of california san diego", "uc san diego", "ucsd",
    "georgia institute of technology", "georgia tech", "university of washington", "zhejiang university",
    "university of maryland college park", "university of michigan", "hong kong university of science and technology", "hkust",
    "northeastern university", "purdue university", "new york university", "nyu", "university of texas at austin", "ut austin",
    "university of wisconsin-madison", "university of wisconsin madison", "university of california los angeles", "ucla",
]
# Further members of a league.
LEAGUE = ["brown university", "dartmouth college", "columbia university", "princeton university"]
# Industry laboratories.
INDUSTRY = [
    "google", "deepmind", "microsoft", "meta platforms", "meta ai", "facebook", "amazon", "apple", "openai", "anthropic", "nvidia",
    "ibm", "adobe", "salesforce", "baidu", "alibaba", "tencent", "huawei", "bell labs", "allen institute for ai",
    "allen institute for artificial intelligence",
]
# Other institutions whose names hold one of the above; blanked in this order before matching.
LOOK_ALIKES = [
    "city university of hong kong", "open university of hong kong", "education university of hong kong",
    "university of michigan-dearborn", "university of michigan-flint", "google scholar",
    "nanjing university of aeronautics and astronautics", "nanjing university of science and technology",
    "nanjing university of posts and telecommunications", "nanjing university of information science and technology",
    "nanjing university of chinese medicine", "nanjing university of finance and economics", "nanjing university of the arts",
    "zhejiang university of technology", "zhejiang university of science and technology",
    "zhejiang university of finance and economics", "zhejiang university of media and communications",
    "california university of pennsylvania", "indiana university of pennsylvania", "bloomsburg university of pennsylvania",
    "clarion university of pennsylvania", "east stroudsburg university of pennsylvania", "edinboro university of pennsylvania",
    "kutztown university of pennsylvania", "lock haven university of pennsylvania", "mansfield university of pennsylvania",
    "millersville university of pennsylvania", "shippensburg university of pennsylvania", "slippery rock university of pennsylvania",
    "west chester university of pennsylvania",
]
# Parts of names of places where papers are deposited.
HOSTS = [
    "arxiv", "biorxiv", "medrxiv", "ssrn", "figshare", "zenodo", "datacite", "dryad", "dataverse", "researchgate", "mendeley",
    "open science framework", "semantic scholar", "openaire", "federal reserve bank", "springer", "elsevier", "wiley",
    "taylor & francis", "mdpi", "hindawi", "preprints.org",
]

TIERS = {"ranked": RANKED, "field": FIELD_RANKED, "league": LEAGUE, "industry": INDUSTRY}
