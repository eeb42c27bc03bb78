"""Signature rules of licences and notices, over texts as lower-case words with one space between them.

A line is ``label | priority | confidence | keyword | pattern``. Every match of the pattern contains the keyword, whole
words that the prefilter looks for (license also as licence). ``~`` stands for up to four words in between, ``<v>`` for an optional word before
a version's number, ``<lic>`` for license or licence. Patterns match whole words.

Priorities: 90 text of a licence or its notice, 80 tags, 70 addresses, 60 names with a version, 40 names, 20 mentions,
10 general words.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    confidence: float
    keyword: str
    pattern: re.Pattern
    base: bool = False


#: Phrases whose places are counted and whose labels always stay.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_RULES = r"""
apache-2.0 | 90 | 1.0 | apache license | licensed under the apache <lic> <v>2(?: 0)? the <lic> you may not use this file
apache-2.0 | 90 | 1.0 | apache license | apache license <v>2 0 january 2004
apache-2.0 | 90 | 0.9 | express or implied | distributed on an as is basis without warranties or conditions of any kind either express or implied
apache-2.0 | 70 | 0.95 | apache org licenses | apache org licenses license 2 0(?: html| txt)?
apache-2.0 | 60 | 0.95 | apache | apache(?: software)? <lic> <v>2(?: 0)?
apache-2.0 | 60 | 0.9 | apache | apache <v>2 0
apache-2.0 | 60 | 0.9 | apache2 | apache2(?: 0)?(?: <lic>)?
apache-1.1 | 60 | 0.9 | apache | apache(?: software)? <lic> <v>1 1
apache-1.0 | 60 | 0.9 | apache | apache(?: software)? <lic> <v>1 0
apache | 40 | 0.7 | apache | apache(?: software)? <lic>
apache | 20 | 0.5 | apache | (?:under|uses|with) the apache(?: foundation)? terms
mit | 90 | 1.0 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 90 | 0.95 | the above copyright notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit | 90 | 0.9 | the software is provided | the software is provided as is without warranty of any kind express or implied including but not limited to
mit | 70 | 0.95 | opensource org licenses mit | opensource org licenses mit(?: license)?(?: php| html)?
mit | 70 | 0.9 | mit license org | mit license org
mit | 40 | 0.9 | mit | (?:the )?mit(?: x11| expat)? <lic>
mit | 40 | 0.8 | mit licensed | mit licensed
mit | 40 | 0.8 | expat | expat <lic>
mit | 20 | 0.7 | mit | (?:licensed|released|available|distributed|published) under(?: the)?(?: terms of(?: the)?)? mit
mit-0 | 60 | 0.9 | mit no attribution | mit no attribution(?: <lic>)?
x11 | 40 | 0.8 | x11 | x11 <lic>
isc | 90 | 1.0 | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee
isc | 70 | 0.9 | opensource org licenses isc | opensource org licenses isc(?: license)?(?: txt| php)?
isc | 40 | 0.9 | isc | (?:the )?isc <lic>
isc | 40 | 0.8 | internet systems consortium | internet systems consortium <lic>
bsd | 90 | 0.9 | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | 90 | 1.0 | endorse or promote products | neither the name of ~may be used to endorse or promote products derived from this software
bsd-3-clause | 90 | 0.9 | endorse or promote products | (?:names? of ~)?contributors may be used to endorse or promote products
bsd-4-clause | 90 | 1.0 | all advertising materials mentioning features | all advertising materials mentioning features or use of this software must display
bsd | 90 | 0.8 | redistributions of source code | redistributions of source code must retain the above copyright notice
bsd | 90 | 0.8 | redistributions in binary form | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | 70 | 0.95 | opensource org licenses bsd | opensource org licenses bsd 3 clause(?: php)?
bsd-2-clause | 70 | 0.95 | opensource org licenses bsd | opensource org licenses bsd 2 clause(?: php)?
bsd | 70 | 0.85 | opensource org licenses bsd | opensource org licenses bsd license(?: php)?
bsd-2-clause | 60 | 0.95 | bsd | (?:simplified bsd|2 clause bsd|two clause bsd|bsd 2 clause|bsd two clause)(?: <lic>)?
bsd-2-clause | 60 | 0.9 | freebsd | freebsd <lic>
bsd-3-clause | 60 | 0.95 | bsd | (?:modified bsd|new bsd|revised bsd|3 clause bsd|three clause bsd|bsd 3 clause|bsd three clause)(?: <lic>)?
bsd-4-clause | 60 | 0.95 | bsd | (?:original bsd|old bsd|4 clause bsd|four clause bsd|bsd 4 clause)(?: <lic>)?
0bsd | 60 | 0.9 | 0bsd | 0bsd(?: <lic>)?
0bsd | 60 | 0.9 | zero clause bsd | zero clause bsd(?: <lic>)?
bsd | 40 | 0.8 | bsd | (?:the )?bsd(?: style| like)? <lic>
bsd | 40 | 0.7 | bsd licensed | bsd licensed
bsd | 20 | 0.6 | bsd | (?:licensed|released|available|distributed) under(?: the)? bsd
gpl-3.0 | 90 | 1.0 | either version 3 of the license | terms of the gnu general public license as published by the free software foundation either version 3 of the license
gpl-2.0 | 90 | 1.0 | either version 2 of the license | terms of the gnu general public license as published by the free software foundation either version 2 of the license
gpl | 90 | 0.9 | free software foundation | terms of the gnu general public license as published by the free software foundation
gpl | 90 | 0.9 | gnu general public license | you should have received a copy of the gnu general public license along with
gpl | 90 | 0.9 | gnu general public license | see the gnu general public license for more details
gpl | 90 | 0.8 | free software you can redistribute it | this program is free software you can redistribute it and or modify
gpl-3.0 | 90 | 1.0 | 29 june 2007 | gnu general public license version 3 29 june 2007
gpl-2.0 | 90 | 1.0 | june 1991 | gnu general public license version 2 june 1991
gpl | 90 | 0.8 | without even the implied warranty | without even the implied warranty of merchantability or fitness for a particular purpose
gpl-3.0 | 70 | 0.95 | gnu org licenses gpl | gnu org licenses gpl 3 0(?: en)?(?: html| txt)?
gpl-2.0 | 70 | 0.95 | gnu org licenses | gnu org licenses(?: old licenses)? gpl 2 0(?: html| txt)?
gpl | 70 | 0.85 | gnu org | gnu org(?: copyleft| licenses) gpl(?: html| txt)?
gpl-3.0 | 60 | 0.95 | general public license | (?:gnu )?general public license <v>3(?: 0)?(?: only| or later| or any later version)?
gpl-2.0 | 60 | 0.95 | general public license | (?:gnu )?general public license <v>2(?: 0)?(?: only| or later| or any later version)?
gpl-1.0 | 60 | 0.9 | general public license | (?:gnu )?general public license <v>1(?: 0)?(?: only| or later)?
gpl-3.0 | 60 | 0.9 | gpl | (?:gnu )?gpl <v>3(?: 0)?(?: only| or later)?
gpl-2.0 | 60 | 0.9 | gpl | (?:gnu )?gpl <v>2(?: 0)?(?: only| or later)?
gpl-3.0 | 60 | 0.9 | gplv3 | (?:gnu )?gplv3(?: only| or later)?
gpl-2.0 | 60 | 0.9 | gplv2 | (?:gnu )?gplv2(?: only| or later)?
gpl-3.0 | 60 | 0.9 | gpl3 | gpl3
gpl-2.0 | 60 | 0.9 | gpl2 | gpl2
gpl-exception | 60 | 0.9 | classpath exception | (?:gnu )?classpath exception
gpl-exception | 60 | 0.8 | linking exception | gpl ~linking exception
gpl | 40 | 0.8 | gnu gpl | (?:the )?gnu gpl
gpl | 40 | 0.8 | gpl | gpl <lic>
gpl | 20 | 0.7 | gpl | (?:licensed|released|available|distributed) under(?: the)?(?: terms of the)?(?: gnu)? gpl
lgpl-3.0 | 90 | 1.0 | lesser general public license | gnu lesser general public license as published by the free software foundation either version 3
lgpl-2.1 | 90 | 1.0 | lesser general public license | gnu lesser general public license as published by the free software foundation either version 2 1
lgpl | 90 | 0.9 | lesser general public license | terms of the gnu lesser general public license
lgpl-3.0 | 70 | 0.95 | gnu org licenses lgpl | gnu org licenses lgpl 3 0(?: en)?(?: html| txt)?
lgpl-2.1 | 70 | 0.95 | gnu org licenses | gnu org licenses(?: old licenses)? lgpl 2 1(?: html| txt)?
lgpl-3.0 | 60 | 0.95 | lesser general public license | (?:gnu )?lesser general public license <v>3(?: 0)?(?: or later)?
lgpl-2.1 | 60 | 0.95 | lesser general public license | (?:gnu )?lesser general public license <v>2 1(?: or later)?
lgpl-2.0 | 60 | 0.9 | library general public license | (?:gnu )?library general public license(?: <v>2(?: 0)?)?
lgpl | 60 | 0.85 | lesser general public license | (?:gnu )?lesser general public license
lgpl-3.0 | 60 | 0.9 | lgpl | (?:gnu )?lgpl <v>3(?: 0)?(?: or later)?
lgpl-2.1 | 60 | 0.9 | lgpl | (?:gnu )?lgpl <v>2 1(?: or later)?
lgpl-3.0 | 60 | 0.9 | lgplv3 | lgplv3
lgpl-2.1 | 60 | 0.9 | lgplv2 | lgplv2(?: 1)?
lgpl | 40 | 0.8 | lgpl | (?:gnu )?lgpl(?: <lic>)?
agpl-3.0 | 90 | 1.0 | affero general public license | gnu affero general public license as published by the free software foundation either version 3
agpl-3.0 | 70 | 0.95 | gnu org licenses agpl | gnu org licenses agpl 3 0(?: en)?(?: html| txt)?
agpl-3.0 | 60 | 0.95 | affero general public license | (?:gnu )?affero general public license <v>3(?: 0)?(?: or later)?
agpl-3.0 | 60 | 0.9 | agpl | (?:gnu )?agpl <v>3(?: 0)?(?: or later)?
agpl-3.0 | 60 | 0.9 | agplv3 | agplv3
agpl | 60 | 0.85 | affero general public license | (?:gnu )?affero general public license
agpl | 40 | 0.8 | agpl | (?:gnu )?agpl(?: <lic>)?
gfdl | 90 | 1.0 | gnu free documentation license | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | 60 | 0.95 | free documentation license | (?:gnu )?free documentation license(?: <v>1 [123])?
gfdl | 40 | 0.85 | gfdl | (?:gnu )?gfdl(?: <lic>)?
gfdl | 90 | 0.8 | no invariant sections | no invariant sections no front cover texts and no back cover texts
mpl-2.0 | 90 | 1.0 | mozilla public license | subject to the terms of the mozilla public license <v>2 0
mpl-2.0 | 70 | 0.95 | mozilla org | mozilla org mpl 2 0
mpl-2.0 | 60 | 0.95 | mozilla public license | mozilla public license <v>2(?: 0)?
mpl-1.1 | 60 | 0.95 | mozilla public license | mozilla public license <v>1 1
mpl-1.0 | 60 | 0.95 | mozilla public license | mozilla public license <v>1 0
mpl-2.0 | 60 | 0.9 | mpl | mpl <v>2(?: 0)?
mpl-1.1 | 60 | 0.9 | mpl | mpl <v>1 1
mpl | 40 | 0.8 | mozilla public license | mozilla public license
mpl | 40 | 0.7 | mpl | mpl <lic>
epl-2.0 | 60 | 0.95 | eclipse public license | eclipse public license <v>2(?: 0)?
epl-1.0 | 60 | 0.95 | eclipse public license | eclipse public license <v>1(?: 0)?
epl | 40 | 0.8 | eclipse public license | eclipse public license
epl-2.0 | 70 | 0.9 | eclipse org legal | eclipse org legal epl(?: v)? ?2 0(?: html)?
epl-1.0 | 70 | 0.9 | eclipse org legal | eclipse org legal epl v10(?: html)?
edl-1.0 | 60 | 0.9 | eclipse distribution license | eclipse distribution license(?: <v>1 0)?
cddl-1.1 | 60 | 0.95 | common development and distribution license | common development and distribution license <v>1 1
cddl-1.0 | 60 | 0.95 | common development and distribution license | common development and distribution license(?: cddl)?(?: <v>1 0)?
cddl | 40 | 0.8 | cddl | cddl(?: <lic>)?
cpl-1.0 | 60 | 0.9 | common public license | common public license(?: <v>1 0)?
cpal-1.0 | 60 | 0.9 | common public attribution license | common public attribution license(?: <v>1 0)?
ipl-1.0 | 60 | 0.9 | ibm public license | ibm public license(?: <v>1 0)?
eupl-1.2 | 60 | 0.95 | european union public | european union public licen[cs]e <v>1 2
eupl-1.1 | 60 | 0.95 | european union public | european union public licen[cs]e <v>1 1
eupl | 40 | 0.85 | european union public | european union public licen[cs]e
eupl | 40 | 0.8 | eupl | eupl(?: <v>1 [12])?
artistic-2.0 | 60 | 0.95 | artistic | artistic <lic> <v>2(?: 0)?
artistic-1.0 | 60 | 0.9 | artistic | artistic <lic> <v>1(?: 0)?
artistic | 40 | 0.8 | artistic | (?:perl )?artistic <lic>
perl | 90 | 0.9 | same terms as perl itself | under the same terms as perl itself
python-2.0 | 60 | 0.9 | python | python(?: software foundation)? <lic> <v>2(?: 0)?
psf | 40 | 0.9 | python software foundation | python software foundation(?: psf)? <lic>
ruby | 40 | 0.8 | ruby | ruby <lic>
php-3.01 | 60 | 0.9 | php | php <lic> <v>3 01
php-3.0 | 60 | 0.9 | php | php <lic> <v>3 0
php | 40 | 0.8 | php | php <lic>
zlib | 90 | 1.0 | in no event will the authors be held liable | in no event will the authors be held liable for any damages arising from the use of this software
zlib | 90 | 0.9 | altered source versions | altered source versions must be plainly marked as such
zlib | 40 | 0.9 | zlib | zlib(?: libpng)? <lic>
libpng | 40 | 0.85 | libpng | libpng <lic>
bsl-1.0 | 60 | 1.0 | boost software license | boost software license <v>1 0(?: 17 august 2003| august 17th 2003)?
bsl-1.0 | 40 | 0.9 | boost | boost(?: software)? <lic>
bsl-1.0 | 70 | 0.9 | boost org license | boost org license 1 0(?: txt)?
bsl-1.1 | 60 | 0.95 | business source license | business source license(?: <v>1 1)?
unlicense | 90 | 1.0 | free and unencumbered software | this is free and unencumbered software released into the public domain
unlicense | 70 | 0.95 | unlicense org | unlicense org
unlicense | 40 | 0.9 | unlicense | (?:the )?unlicense
wtfpl | 40 | 0.95 | wtfpl | wtfpl(?: <v>2(?: 0)?)?
wtfpl | 60 | 0.95 | do what the fuck you want to | do what the fuck you want to public license
beerware | 40 | 0.9 | beerware | beerware(?: <lic>)?
beerware | 90 | 0.9 | buy me a beer | you can buy me a beer in return
cc0-1.0 | 70 | 1.0 | creativecommons org publicdomain zero | creativecommons org publicdomain zero 1 0
cc0-1.0 | 60 | 0.95 | cc0 | cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0-1.0 | 60 | 0.95 | creative commons zero | creative commons zero(?: <v>1 0)?(?: universal)?
cc-by-nc-nd | 70 | 1.0 | creativecommons org licenses by | creativecommons org licenses by nc nd [1-4] [05]
cc-by-nc-sa | 70 | 1.0 | creativecommons org licenses by | creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc | 70 | 1.0 | creativecommons org licenses by | creativecommons org licenses by nc [1-4] [05]
cc-by-nd | 70 | 1.0 | creativecommons org licenses by | creativecommons org licenses by nd [1-4] [05]
cc-by-sa | 70 | 1.0 | creativecommons org licenses by | creativecommons org licenses by sa [1-4] [05]
cc-by | 70 | 1.0 | creativecommons org licenses by | creativecommons org licenses by [1-4] [05]
cc-by-nc-nd | 60 | 0.95 | cc by | cc by nc nd(?: [1-4] [05])?
cc-by-nc-sa | 60 | 0.95 | cc by | cc by nc sa(?: [1-4] [05])?
cc-by-nc | 60 | 0.95 | cc by | cc by nc(?: [1-4] [05])?
cc-by-nd | 60 | 0.95 | cc by | cc by nd(?: [1-4] [05])?
cc-by-sa | 60 | 0.95 | cc by | cc by sa(?: [1-4] [05])?
cc-by-4.0 | 60 | 0.95 | cc by | cc by 4 0
cc-by-3.0 | 60 | 0.95 | cc by | cc by 3 0
cc-by-2.5 | 60 | 0.95 | cc by | cc by 2 5
cc-by-2.0 | 60 | 0.95 | cc by | cc by 2 0
cc-by-nc-nd | 60 | 0.95 | attribution | (?:creative commons )?attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported)?
cc-by-nc-sa | 60 | 0.95 | attribution | (?:creative commons )?attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?
cc-by-nc | 60 | 0.9 | attribution | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?
cc-by-nd | 60 | 0.9 | attribution | creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported)?
cc-by-sa | 60 | 0.95 | attribution | (?:creative commons )?attribution share ?alike(?: [1-4] [05])?(?: international| unported)?
cc-by-4.0 | 60 | 0.95 | attribution 4 0 international | creative commons attribution 4 0 international
cc-by-3.0 | 60 | 0.95 | attribution 3 0 | creative commons attribution 3 0(?: unported)?
cc-by | 40 | 0.9 | creative commons attribution | creative commons attribution(?: <lic>)?
creative-commons | 40 | 0.7 | creative commons | creative commons <lic>
creative-commons | 70 | 0.7 | creativecommons org | creativecommons org(?: licenses)?
creative-commons | 20 | 0.6 | creative commons | (?:licensed|released|available|published) under(?: a| the)? creative commons
odbl-1.0 | 60 | 0.95 | open database license | open database license(?: odbl)?(?: <v>1 0)?
odbl-1.0 | 40 | 0.85 | odbl | odbl(?: <lic>)?
odc-by-1.0 | 60 | 0.95 | open data commons attribution license | open data commons attribution license(?: <v>1 0)?
pddl-1.0 | 60 | 0.95 | public domain dedication and license | public domain dedication and license(?: <v>1 0)?
cdla-permissive | 60 | 0.95 | community data license agreement | community data license agreement permissive(?: <v>[12] 0)?
cdla-sharing | 60 | 0.95 | community data license agreement | community data license agreement sharing(?: <v>1 0)?
ogl-uk | 60 | 0.95 | open government | open government licen[cs]e(?: <v>[123] 0)?
ofl-1.1 | 60 | 0.95 | open font license | (?:sil )?open font license(?: <v>1 1)?
ofl-1.1 | 70 | 0.9 | scripts sil org ofl | scripts sil org ofl
ofl-1.1 | 40 | 0.7 | ofl | sil ofl
ubuntu-font | 60 | 0.9 | ubuntu font | ubuntu font licen[cs]e(?: <v>1 0)?
upl-1.0 | 60 | 0.9 | universal permissive license | universal permissive license(?: <v>1 0)?
ms-pl | 60 | 0.9 | microsoft public license | microsoft public license(?: ms pl)?
ms-rl | 60 | 0.9 | microsoft reciprocal license | microsoft reciprocal license(?: ms rl)?
ncsa | 60 | 0.9 | university of illinois | university of illinois(?: ncsa)? open source license
ncsa | 60 | 0.8 | ncsa open source license | ncsa open source license
afl-3.0 | 60 | 0.9 | academic free license | academic free license(?: <v>3 0)?
osl-3.0 | 60 | 0.9 | open software license | open software license(?: <v>3 0)?
ecl-2.0 | 60 | 0.9 | educational community license | educational community license(?: <v>2 0)?
rpl-1.5 | 60 | 0.9 | reciprocal public license | reciprocal public license(?: <v>1 5)?
qpl-1.0 | 60 | 0.9 | q public license | q public license(?: <v>1 0)?
sleepycat | 40 | 0.9 | sleepycat | sleepycat(?: public)? <lic>
openssl | 40 | 0.9 | openssl | openssl <lic>
openssl | 90 | 0.9 | openssl project | this product includes software developed by the openssl project
w3c | 40 | 0.9 | w3c software | w3c software(?: notice)?(?: and document)?(?: notice and)? <lic>
tcl | 40 | 0.8 | tcl | tcl(?: tk)? <lic>
vim | 40 | 0.85 | vim | vim <lic>
curl | 40 | 0.85 | curl | curl <lic>
icu | 40 | 0.85 | icu | icu <lic>
unicode | 60 | 0.9 | unicode | unicode(?: inc)? license agreement(?: data files and software)?
ijg | 40 | 0.9 | independent jpeg group | independent jpeg group(?: s)?(?: <lic>)?
postgresql | 40 | 0.9 | postgresql | postgresql <lic>
intel | 40 | 0.7 | intel | intel open source <lic>
nasa-1.3 | 60 | 0.9 | nasa open source agreement | nasa open source agreement(?: <v>1 3)?
cecill-2.1 | 60 | 0.9 | cecill | cecill(?: free software)?(?: <lic>)?(?: agreement)? <v>2 1
cecill | 40 | 0.85 | cecill | cecill(?: b| c)?(?: <lic>)?
mulan-psl-2.0 | 60 | 0.9 | mulan | mulan(?: permissive software)? <lic> <v>2
mulan-psl | 40 | 0.85 | mulan | mulan(?: psl| permissive software)(?: <lic>)?
sspl-1.0 | 60 | 0.95 | server side public license | server side public license(?: <v>1(?: 0)?)?
elastic-2.0 | 60 | 0.95 | elastic license | elastic license(?: <v>2(?: 0)?)?
commons-clause | 60 | 0.95 | commons clause | commons clause(?: <lic>)?(?: condition)?(?: <v>1 0)?
polyform | 60 | 0.95 | polyform | polyform (?:noncommercial|non commercial|small business|shield|strict|perimeter|internal use|free trial)(?: <lic>)?(?: 1 0 0)?
openrail | 60 | 0.9 | openrail | (?:creativeml |bigscience )?openrail(?: m)?(?: <lic>)?
rail | 60 | 0.9 | responsible ai license | responsible ai license
prosperity | 60 | 0.9 | prosperity public license | prosperity public license(?: <v>[23] 0 0)?
parity | 60 | 0.9 | parity public license | parity public license(?: <v>[67] 0 0)?
blueoak-1.0.0 | 60 | 0.9 | blue oak model license | blue oak model license(?: <v>1 0 0)?
hippocratic | 60 | 0.9 | hippocratic | hippocratic <lic>(?: <v>[123] [01])?
json | 90 | 0.9 | good not evil | the software shall be used for good not evil
public-domain | 90 | 0.9 | public domain | (?:placed|released|dedicated)(?: [^ ]+){0,2} (?:in|into|to) the public domain
public-domain | 40 | 0.7 | public domain | (?:is|are|in) (?:in )?(?:the )?public domain
public-domain | 20 | 0.5 | public domain | public domain(?: work| software| image| text)?
proprietary | 90 | 0.9 | proprietary and confidential | proprietary and confidential(?: information)?
proprietary | 90 | 0.9 | unauthorized copying | unauthorized copying of this file via any medium is strictly prohibited
proprietary | 90 | 0.85 | may not be reproduced | may not be reproduced ~without(?: the)?(?: prior)?(?: express)? written (?:permission|consent)
proprietary | 90 | 0.85 | written permission | (?:reproduction|redistribution|copying|reprinting) ~without(?: prior)?(?: express)? written permission(?: is prohibited)?
proprietary | 90 | 0.8 | no part of this | no part of this (?:publication|book|work|document|site) may be (?:reproduced|copied|stored|transmitted)
proprietary | 60 | 0.8 | end user license agreement | end user license agreement(?: eula)?
proprietary | 40 | 0.6 | eula | (?:the )?eula
proprietary | 40 | 0.7 | proprietary | proprietary <lic>
proprietary | 40 | 0.6 | trade secrets | contains ~trade secrets
commercial | 40 | 0.7 | commercial | (?:a )?commercial <lic>
dual-license | 40 | 0.6 | dual licensed | dual licensed(?: under)?
dual-license | 40 | 0.6 | dual | dual <lic>
non-commercial | 40 | 0.6 | non commercial use only | (?:for )?non commercial use only
non-commercial | 40 | 0.6 | noncommercial use only | (?:for )?noncommercial use only
non-commercial | 40 | 0.6 | personal use only | (?:for )?personal use only
academic-use | 40 | 0.6 | purposes only | (?:for )?(?:academic|research)(?: and [^ ]+)? (?:research )?purposes only
fair-use | 40 | 0.5 | fair use | (?:under |as )?fair use(?: doctrine| policy)?
gov-work | 90 | 0.8 | united states government | (?:a )?work of the united states government
gov-work | 90 | 0.8 | us government | (?:a )?work of the us government
copyleft | 20 | 0.4 | copyleft | copyleft
permission | 90 | 0.7 | with permission | (?:reprinted |reproduced |used )(?:and used )?with permission(?: of| from)?
permission | 20 | 0.5 | by permission | (?:reprinted|reproduced|used) by permission
contributor-agreement | 40 | 0.6 | contributor license agreement | contributor license agreement
terms | 20 | 0.4 | terms of use | (?:subject to |see )?(?:our |the )?terms of use
terms | 20 | 0.4 | terms of service | (?:subject to |see )?(?:our |the )?terms of service
terms | 20 | 0.4 | terms and conditions | (?:subject to )?(?:our |the )?terms and conditions
copyright | 40 | 0.6 | copyright c | copyright c (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?
copyright | 40 | 0.6 | copyright | copyright(?: by)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?
copyright | 20 | 0.4 | copyright notice | copyright notice
copyright | 20 | 0.4 | copyright holder | (?:the )?copyright holder
copyright | 20 | 0.4 | copyright holders | (?:the )?copyright holders
copyright | 20 | 0.4 | copyrighted | copyrighted(?: material| work| by)?
reserved | 40 | 0.7 | some rights reserved | some rights reserved
reserved | 40 | 0.7 | no rights reserved | no rights reserved
reserved | 40 | 0.7 | alle rechte vorbehalten | alle rechte vorbehalten
reserved | 40 | 0.7 | tous droits | tous droits r[^ ]*serv[^ ]+
reserved | 40 | 0.7 | todos los derechos reservados | todos los derechos reservados
warranty | 20 | 0.4 | without warranty | without warranty of any kind
warranty | 20 | 0.4 | without any warranty | without any warranty
warranty | 10 | 0.3 | as is | (?:is )?provided(?: [^ ]+){0,3} as is
open-source | 20 | 0.4 | open source license | (?:an )?open source license
open-source | 20 | 0.4 | osi approved | osi approved(?: <lic>)?
license | 10 | 0.3 | licensed under | licensed under(?: the| a| an)?
license | 10 | 0.3 | license agreement | license agreement
license | 10 | 0.3 | under license | (?:used )?under license(?: from| by)?
license | 10 | 0.3 | see license | see license(?: file| txt| md)?
license | 10 | 0.3 | license file | (?:see )?(?:the )?license file
"""

#: Identifiers of the tag ``SPDX-License-Identifier``; each gives one rule, and a longer identifier contains a shorter.
SPDX = """
0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BlueOak-1.0.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause
BSL-1.0 BUSL-1.1 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 CC-BY-ND-4.0 CC0-1.0 CDDL-1.0
CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0
GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0
MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OSL-3.0 PDDL-1.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 SSPL-1.0 Unlicense UPL-1.0 Vim W3C
WTFPL X11 Zlib
""".split()


def compiled(pattern: str) -> re.Pattern:
    wide = pattern.replace("<v>", "(?:(?:version|ver|v) ?)?").replace("<lic>", "licen[cs]e").replace("~", "(?:[^ ]+ ){0,4}")
    return re.compile(f"(?<= )(?:{wide})(?= )")


def rules() -> list[Rule]:
    """The rules in order: base phrases, tags, then the lines above."""
    found = [Rule(label, 50, 0.9 if label != "reserved" else 0.6, phrase, compiled(phrase), base=True) for phrase, label in BASE.items()]
    tag = "spdx license identifier"
    for name in SPDX:
        words = re.sub(r"[^0-9a-z]+", " ", name.lower())
        found.append(Rule(name.lower(), 80, 1.0, f"{tag} {words.split(' ')[0]}", compiled(f"{tag} {words}")))
    for line in _RULES.strip().splitlines():
        label, priority, confidence, keyword, pattern = (part.strip() for part in line.split(" | "))
        found.append(Rule(label, int(priority), float(confidence), keyword, compiled(pattern)))
    return found
