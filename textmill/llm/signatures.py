"""The license scan's signatures: one line for each rule, in the order in which ties are decided.

label | priority | weight | keywords, the longest word of one of which every match holds | pattern

Patterns are matched against lower-case text. In them a space stands for any white space, <l> for
both spellings of license, and <vN> for a version N with or without "version" or "v" in front.
Priority 0 is for tags and addresses that name one license, 1 for sentences of license texts and
grants, 2 for names with a version, 3 for names, 4 and 5 for vague statements.
"""

from __future__ import annotations

import re

# Signatures written by hand from the public texts, notices and tags of the licenses.
TABLE = r"""
mit | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?mit(?![\w.-])
mit-0 | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?mit-0(?![\w.-])
apache | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?apache-(?:1\.0|1\.1|2\.0)(?![\w.-])
gpl | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?gpl-(?:1\.0|2\.0|3\.0)(?:\+|-only|-or-later)?(?![\w.-])
lgpl | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?lgpl-(?:2\.0|2\.1|3\.0)(?:\+|-only|-or-later)?(?![\w.-])
agpl | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?agpl-(?:1\.0|3\.0)(?:-only|-or-later)?(?![\w.-])
mpl | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?mpl-(?:1\.0|1\.1|2\.0)(?![\w.])
bsd-2-clause | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?bsd-2-clause(?![\w.])
bsd-3-clause | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?bsd-3-clause(?![\w.])
bsd-4-clause | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?bsd-4-clause(?![\w.])
0bsd | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?0bsd(?![\w.-])
isc | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?isc(?![\w.-])
zlib | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?zlib(?![\w.-])
bsl | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?bsl-1\.0(?![\w.-])
busl | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?busl-1\.1(?![\w.-])
unlicense | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?unlicense(?![\w.-])
wtfpl | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?wtfpl(?![\w.-])
epl | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?epl-(?:1\.0|2\.0)(?![\w.-])
eupl | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?eupl-1\.(?:0|1|2)(?![\w.-])
cddl | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?cddl-1\.(?:0|1)(?![\w.-])
cpl | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?cpl-1\.0(?![\w.-])
artistic | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?artistic-(?:1\.0|2\.0)(?![\w.])
cc0 | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?cc0-1\.0(?![\w.-])
cc-by | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?cc-by-(?:1\.0|2\.0|2\.5|3\.0|4\.0)(?![\w.-])
cc-by-sa | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?cc-by-sa-(?:1\.0|2\.0|2\.5|3\.0|4\.0)(?![\w.-])
cc-by-nd | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?cc-by-nd-(?:1\.0|2\.0|2\.5|3\.0|4\.0)(?![\w.-])
cc-by-nc | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?cc-by-nc-(?:1\.0|2\.0|2\.5|3\.0|4\.0)(?![\w.-])
cc-by-nc-sa | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?cc-by-nc-sa-(?:1\.0|2\.0|2\.5|3\.0|4\.0)(?![\w.-])
cc-by-nc-nd | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?cc-by-nc-nd-(?:1\.0|2\.0|2\.5|3\.0|4\.0)(?![\w.-])
gfdl | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?gfdl-1\.(?:1|2|3)(?:-only|-or-later)?(?![\w.])
ofl | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?ofl-1\.(?:0|1)(?![\w.])
odbl | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?odbl-1\.0(?![\w.-])
pddl | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?pddl-1\.0(?![\w.-])
ms-pl | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?ms-pl(?![\w.-])
ms-rl | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?ms-rl(?![\w.-])
postgresql | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?postgresql(?![\w.-])
python | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?(?:psf-2\.0|python-2\.0)(?![\w.])
php | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?php-3\.01?(?![\w.-])
ruby | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?ruby(?![\w.-])
openssl | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?openssl(?![\w.-])
vim | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?vim(?![\w.-])
upl | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?upl-1\.0(?![\w.-])
afl | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?afl-(?:1\.1|1\.2|2\.0|2\.1|3\.0)(?![\w.-])
osl | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?osl-(?:1\.0|1\.1|2\.0|2\.1|3\.0)(?![\w.-])
ncsa | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?ncsa(?![\w.-])
mulanpsl | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?mulanpsl-(?:1\.0|2\.0)(?![\w.-])
blueoak | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?blueoak-1\.0\.0(?![\w.-])
sspl | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?sspl-1\.0(?![\w.-])
elastic | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?elastic-2\.0(?![\w.-])
cecill | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?cecill-(?:1\.0|1\.1|2\.0|2\.1|b|c)(?![\w.-])
unicode | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?unicode-(?:dfs-2015|dfs-2016|3\.0)(?![\w.-])
w3c | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?w3c(?![\w.-])
x11 | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?x11(?![\w.-])
curl | 0 | 1.0 | spdx-license | spdx-license-identifier: ?\(?curl(?![\w.-])
mit | 0 | 0.95 | opensource.org | https?://(?:www\.)?opensource\.org/licenses?/mit(?![\w-])
apache | 0 | 0.95 | opensource.org | https?://(?:www\.)?opensource\.org/licenses?/apache-2\.0(?![\w-])
bsd-2-clause | 0 | 0.95 | opensource.org | https?://(?:www\.)?opensource\.org/licenses?/bsd-2-clause(?![\w-])
bsd-3-clause | 0 | 0.95 | opensource.org | https?://(?:www\.)?opensource\.org/licenses?/bsd-3-clause(?![\w-])
isc | 0 | 0.95 | opensource.org | https?://(?:www\.)?opensource\.org/licenses?/isc(?![\w-])
artistic | 0 | 0.95 | opensource.org | https?://(?:www\.)?opensource\.org/licenses?/artistic-2\.0(?![\w-])
epl | 0 | 0.95 | opensource.org | https?://(?:www\.)?opensource\.org/licenses?/epl-[12]\.0(?![\w-])
apache | 0 | 0.95 | apache.org | https?://www\.apache\.org/licenses/license-(?:1\.0|1\.1|2\.0)
apache | 0 | 0.95 | apache.org | https?://www\.apache\.org/licenses/?(?![\w/])
lgpl | 0 | 0.95 | gnu.org | https?://www\.gnu\.org/(?:licenses|copyleft)/(?:old-licenses/)?lgpl
agpl | 0 | 0.95 | gnu.org | https?://www\.gnu\.org/(?:licenses|copyleft)/agpl
gfdl | 0 | 0.95 | gnu.org | https?://www\.gnu\.org/(?:licenses|copyleft)/fdl
gpl | 0 | 0.95 | gnu.org | https?://www\.gnu\.org/(?:licenses|copyleft)/(?:old-licenses/)?gpl
gpl | 3 | 0.7 | gnu.org | https?://www\.gnu\.org/licenses/?(?![\w/])
mpl | 0 | 0.95 | mozilla.org | https?://(?:www\.)?mozilla\.org/mpl/
cc-by-nc-nd | 0 | 0.95 | creativecommons.org | https?://creativecommons\.org/licenses/by-nc-nd/
cc-by-nc-sa | 0 | 0.95 | creativecommons.org | https?://creativecommons\.org/licenses/by-nc-sa/
cc-by-nc | 0 | 0.95 | creativecommons.org | https?://creativecommons\.org/licenses/by-nc/
cc-by-nd | 0 | 0.95 | creativecommons.org | https?://creativecommons\.org/licenses/by-nd/
cc-by-sa | 0 | 0.95 | creativecommons.org | https?://creativecommons\.org/licenses/by-sa/
cc-by | 0 | 0.95 | creativecommons.org | https?://creativecommons\.org/licenses/by/
cc0 | 0 | 0.95 | creativecommons.org | https?://creativecommons\.org/publicdomain/zero/
public-domain | 0 | 0.95 | creativecommons.org | https?://creativecommons\.org/publicdomain/mark/
epl | 0 | 0.95 | eclipse.org | https?://www\.eclipse\.org/legal/epl-(?:v10|2\.0)
bsl | 0 | 0.95 | boost.org | https?://www\.boost\.org/license_1_0\.txt
ofl | 0 | 0.95 | sil.org | https?://scripts\.sil\.org/ofl
wtfpl | 0 | 0.95 | wtfpl.net | https?://(?:www|sam\.zoy)?\.?wtfpl\.net
unlicense | 0 | 0.95 | unlicense.org | https?://unlicense\.org
odbl | 0 | 0.95 | opendatacommons.org | https?://opendatacommons\.org/licenses/odbl
pddl | 0 | 0.95 | opendatacommons.org | https?://opendatacommons\.org/licenses/pddl
php | 0 | 0.95 | php.net | https?://www\.php\.net/license/3_01?\.txt
ms-pl | 0 | 0.95 | microsoft.com | https?://(?:www\.)?microsoft\.com/opensource/licenses\.mspx
eupl | 0 | 0.95 | europa.eu | https?://(?:ec|joinup\.ec)\.europa\.eu/(?:idabc/eupl|software/page/eupl)
mit | 1 | 0.95 | permission is | permission is hereby granted, free of charge, to any person obtaining a copy
mit | 1 | 0.9 | included in all | the above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in all copies or substantial portions
mit | 1 | 0.8 | liable for any | in no event shall the authors or copyright holders be liable for any claim
mit | 1 | 0.95 | mit | (?:licen[sc]ed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?mit(?:/x11|/expat)? <l>(?!\w)
mit | 1 | 0.95 | mit | (?:under|per) the (?:terms|conditions|provisions) of (?:the )?mit(?:/x11)?(?: <l>)?(?!\w)(?! \w+[- ]licen)
mit | 2 | 0.85 | mit | (?:subject to|governed by|covered by|compatible with|see|copy of) (?:the )?mit(?:/x11)? <l>(?!\w)
mit | 2 | 0.85 | license|licence | <l>(?::| =) ?["']?mit(?![\w.-])
mit | 2 | 0.9 | mit | (?<!\w)the mit <l> \(mit\)
mit | 3 | 0.8 | mit|expat | (?<!\w)(?:mit|expat)[ /-](?:style )?<l>(?!\w)
x11 | 1 | 0.9 | x consortium | except as contained in this notice, the name of the x consortium shall not be used
mit-0 | 3 | 0.8 | no attribution | (?<!\w)mit no attribution(?: <l>)?(?!\w)
apache | 1 | 0.95 | apache | licensed under the apache <l><v2(?:\.0)?>(?!\w)
apache | 1 | 0.95 | apache | (?:licen[sc]ed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? <l>(?!\w)
apache | 1 | 0.95 | apache | (?:under|per) the (?:terms|conditions|provisions) of (?:the )?apache(?: software)?(?: <l>)?(?!\w)
apache | 1 | 0.9 | compliance with | you may not use this file except in compliance with the <l>
apache | 1 | 0.85 | applicable law | unless required by applicable law or agreed to in writing, software distributed under the <l> is distributed on an "?as is"? basis
apache | 1 | 0.9 | perpetual, worldwide | each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable
apache | 1 | 0.85 | apache software foundation | licensed to the apache software foundation \(asf\) under one or more contributor <l> agreements
apache | 1 | 0.85 | apache software foundation | this product includes software developed (?:by|at) the apache software foundation
apache | 2 | 0.9 | apache | (?<!\w)apache(?: software)? <l><v(?:1\.0|1\.1|2(?:\.0)?)>(?![\w.])
apache | 2 | 0.85 | license|licence | <l>(?::| =) ?["']?apache(?:[ -](?:license )?v?2(?:\.0)?)?(?![\w-])
apache | 2 | 0.85 | apache | (?:subject to|governed by|covered by|compatible with|see|copy of) (?:the )?apache(?: software)? <l>(?!\w)
apache | 3 | 0.8 | apache | (?<!\w)apache(?: software)?[ -]<l>(?!\w)
gpl | 1 | 0.95 | free software | this program is free software(?:[;:,]|\. )? ?you can redistribute it and/or modify it under the terms of the gnu general public <l>
gpl | 1 | 0.9 | general public | see the gnu general public <l> for more details
gpl | 1 | 0.9 | general public | you should have received a copy of the gnu general public <l>
gpl | 1 | 0.95 | general public | (?:licen[sc]ed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public <l>(?!\w)
gpl | 1 | 0.95 | general public | (?:under|per) the (?:terms|conditions|provisions) of (?:the )?(?:gnu )?general public <l>(?!\w)
gpl | 2 | 0.9 | general public | (?<!\w)(?:gnu )?general public <l><v(?:[123](?:\.0)?)>(?:,? or (?:\(at your option\) )?any later version)?(?![\w.])
gpl | 2 | 0.9 | gpl | (?<![\w-])(?:gnu )?gplv?[- ]?[123](?:\.0)?\+?(?![\w.])
gpl | 2 | 0.85 | license|licence | <l>(?::| =) ?["']?(?:gnu )?gpl(?:v[123]|-[123]\.0)?(?:\+|-only|-or-later)?(?![\w-])
gpl | 2 | 0.85 | gpl | (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:gnu )?gpl(?!\w)
gpl | 3 | 0.8 | general public | (?<!\w)(?:gnu )?general public <l>(?!\w)
gpl | 1 | 0.85 | copyleft | the gnu general public <l> is a free, copyleft <l> for software
lgpl | 1 | 0.95 | lesser|library | (?:this|the) (?:library|program) is free software(?:[;:,]|\. )? ?you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public <l>
lgpl | 1 | 0.9 | lesser|library | see the gnu (?:lesser|library) general public <l> for more details
lgpl | 1 | 0.9 | lesser|library | you should have received a copy of the gnu (?:lesser|library) general public <l>
lgpl | 1 | 0.95 | lesser|library | (?:licen[sc]ed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lesser|library) general public <l>(?:<v(?:[23](?:\.[01])?)>)?(?!\w)
lgpl | 1 | 0.95 | lesser|library | (?:under|per) the (?:terms|conditions|provisions) of (?:the )?(?:gnu )?(?:lesser|library) general public <l>(?!\w)
lgpl | 2 | 0.9 | lesser|library | (?<!\w)(?:gnu )?(?:lesser|library) general public <l><v(?:[23](?:\.[01])?)>(?:,? or (?:\(at your option\) )?any later version)?(?![\w.])
lgpl | 2 | 0.9 | lgpl | (?<![\w-])lgplv?[- ]?[23](?:\.[01])?\+?(?![\w.])
lgpl | 3 | 0.8 | lesser|library | (?<!\w)(?:gnu )?(?:lesser|library) general public <l>(?!\w)
lgpl | 3 | 0.75 | lgpl | (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:gnu )?lgpl(?!\w)
agpl | 1 | 0.95 | affero | it under the terms of the gnu affero general public <l>
agpl | 1 | 0.9 | affero | (?:see|copy of) the gnu affero general public <l>
agpl | 1 | 0.95 | affero | (?:licen[sc]ed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?affero general public <l>(?!\w)
agpl | 2 | 0.9 | affero | (?<!\w)(?:gnu )?affero general public <l><v3(?:\.0)?>(?![\w.])
agpl | 2 | 0.9 | agpl | (?<![\w-])agplv?[- ]?3(?:\.0)?\+?(?![\w.])
agpl | 3 | 0.8 | affero | (?<!\w)(?:gnu )?affero general public <l>(?!\w)
gfdl | 1 | 0.95 | free documentation | permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation <l>
gfdl | 2 | 0.9 | free documentation | (?<!\w)(?:gnu )?free documentation <l><v1\.[123]>(?![\w.])
gfdl | 3 | 0.8 | free documentation | (?<!\w)(?:gnu )?free documentation <l>(?!\w)
mpl | 1 | 0.95 | mozilla | this source code form is subject to the terms of the mozilla public <l>
mpl | 1 | 0.9 | mpl | if a copy of the mpl was not distributed with this file
mpl | 1 | 0.9 | mozilla | the contents of this file are subject to the mozilla public <l>
mpl | 1 | 0.95 | mozilla | (?:licen[sc]ed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?mozilla public <l>(?!\w)
mpl | 2 | 0.9 | mozilla | (?<!\w)mozilla public <l><v(?:1\.0|1\.1|2(?:\.0)?)>(?![\w.])
mpl | 3 | 0.8 | mozilla | (?<!\w)mozilla public <l>(?!\w)
bsd | 1 | 0.95 | redistribution and use | redistribution and use in source and binary forms, with or without modification, are permitted
bsd | 1 | 0.85 | redistributions of source | redistributions of source code must retain the above copyright notice
bsd | 1 | 0.85 | redistributions in binary | redistributions in binary form must reproduce the above copyright notice
bsd | 1 | 0.8 | copyright holders and contributors | this software is provided by the copyright holders and contributors "?as is"?
bsd-3-clause | 1 | 0.9 | endorse or promote | nor the names of (?:its|his|their|any) contributors may be used to endorse or promote
bsd-4-clause | 1 | 0.9 | advertising materials | all advertising materials mentioning features or use of this software must display
bsd-2-clause | 2 | 0.9 | bsd | (?<!\w)(?:2|two)[- ]clause bsd(?: <l>)?(?!\w)
bsd-2-clause | 2 | 0.9 | bsd | (?<!\w)(?:simplified bsd|freebsd) <l>(?!\w)
bsd-2-clause | 2 | 0.9 | bsd | (?<!\w)bsd[- ](?:2|two)[- ]clause(?: <l>)?(?!\w)
bsd-3-clause | 2 | 0.9 | bsd | (?<!\w)(?:3|three)[- ]clause bsd(?: <l>)?(?!\w)
bsd-3-clause | 2 | 0.9 | bsd | (?<!\w)bsd[- ](?:3|three)[- ]clause(?: <l>)?(?!\w)
bsd-3-clause | 2 | 0.9 | bsd | (?<!\w)(?:new|modified|revised) bsd <l>(?!\w)
bsd-4-clause | 2 | 0.9 | bsd | (?<!\w)(?:original bsd|bsd[- ]4[- ]clause)(?: <l>)?(?!\w)
bsd | 1 | 0.95 | bsd | (?:licen[sc]ed|released|distributed|published|available|provided) under (?:the |a )?(?:terms of )?(?:the )?bsd(?:-style| style)? <l>(?!\w)
bsd | 3 | 0.8 | bsd | (?<!\w)bsd(?:-style| style|-like)? <l>(?!\w)
0bsd | 3 | 0.8 | bsd | (?<!\w)(?:zero[- ]clause bsd|bsd zero clause)(?: <l>)?(?!\w)
isc | 1 | 0.95 | permission to use | permission to use, copy, modify, and/?(?:or)? distribute this software for any purpose
isc | 1 | 0.9 | disclaims all | the author disclaims all warranties with regard to this software
isc | 3 | 0.8 | isc | (?<!\w)isc <l>(?!\w)
zlib | 1 | 0.95 | express or implied | this software is provided 'as-is', without any express or implied warranty
zlib | 1 | 0.9 | misrepresented | the origin of this software must not be misrepresented
zlib | 3 | 0.8 | zlib | (?<!\w)zlib(?:/libpng)? <l>(?!\w)
bsl | 1 | 0.95 | boost | distributed under the boost software <l>
bsl | 3 | 0.8 | boost | (?<!\w)boost software <l>(?:<v1\.0>)?(?![\w.])
busl | 1 | 0.9 | business source | (?:under|governed by) the (?:terms of the )?business source <l>(?:<v1\.1>)?(?![\w.])
busl | 3 | 0.8 | business source | (?<!\w)business source <l>(?!\w)
unlicense | 1 | 0.95 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 3 | 0.8 | unlicense | (?<!\w)the unlicense(?!\w)
wtfpl | 1 | 0.95 | fuck | you just do what the fuck you want to
wtfpl | 3 | 0.9 | fuck | (?<!\w)do what the fuck you want to public <l>(?!\w)
epl | 1 | 0.95 | eclipse | (?:made available|distributed|released|licensed|provided) under the terms of the eclipse public <l>(?!\w)
epl | 2 | 0.9 | eclipse | (?<!\w)eclipse public <l>(?: -|,)?<v[12]\.0>(?![\w.])
epl | 3 | 0.8 | eclipse | (?<!\w)eclipse public <l>(?!\w)
eupl | 1 | 0.95 | eupl|european union | licensed under the (?:eupl|european union public <l>)(?!\w)
eupl | 3 | 0.8 | european union | (?<!\w)european union public <l>(?!\w)
cddl | 1 | 0.9 | common development | subject to the terms of the common development and distribution <l>
cddl | 3 | 0.8 | common development | (?<!\w)common development and distribution <l>(?!\w)
cpl | 3 | 0.8 | common public | (?<!\w)common public <l>(?!\w)
artistic | 1 | 0.9 | artistic | under the (?:terms of )?(?:the )?(?:perl )?artistic <l>(?!\w)
artistic | 2 | 0.9 | artistic | (?<!\w)artistic <l><v[12](?:\.0)?>(?![\w.])
artistic | 3 | 0.8 | artistic | (?<!\w)(?:the )?artistic <l>(?!\w)
perl | 1 | 0.9 | perl | redistribute it and/or modify it under the same terms as perl itself
ms-pl | 3 | 0.8 | microsoft | (?<!\w)microsoft public <l>(?!\w)
ms-rl | 3 | 0.8 | microsoft | (?<!\w)microsoft reciprocal <l>(?!\w)
python | 1 | 0.9 | python | (?<!\w)psf <l> agreement for python
python | 3 | 0.8 | python | (?<!\w)python software foundation <l>(?!\w)
php | 1 | 0.9 | php | subject to version 3\.01? of the php <l>
php | 3 | 0.8 | php | (?<!\w)the php <l>(?!\w)
ruby | 3 | 0.8 | ruby | (?<!\w)(?:the )?ruby <l>(?!\w)
openssl | 1 | 0.9 | openssl | this product includes software developed by the openssl project
openssl | 3 | 0.8 | openssl | (?<!\w)openssl <l>(?!\w)
postgresql | 3 | 0.8 | postgresql | (?<!\w)postgresql <l>(?!\w)
vim | 3 | 0.8 | vim | (?<!\w)vim <l>(?!\w)
curl | 3 | 0.8 | curl | (?<!\w)curl <l>(?!\w)
ncsa | 3 | 0.8 | ncsa | (?<!\w)(?:university of illinois/)?ncsa open source <l>(?!\w)
upl | 3 | 0.8 | universal permissive | (?<!\w)universal permissive <l>(?!\w)
afl | 3 | 0.8 | academic free | (?<!\w)academic free <l>(?:<v[123]\.[012]>)?(?![\w.])
osl | 3 | 0.8 | open software | (?<!\w)open software <l>(?:<v[123]\.[01]>)?(?![\w.])
cecill | 1 | 0.9 | cecill | (?:governed by|under) the cecill(?:-[abc])? <l>(?!\w)
cecill | 3 | 0.8 | cecill | (?<!\w)cecill(?:-[abc])? <l>(?!\w)
sspl | 1 | 0.9 | server side | under the (?:terms of the )?server side public <l>(?!\w)
sspl | 3 | 0.8 | server side | (?<!\w)server side public <l>(?!\w)
elastic | 1 | 0.9 | elastic | (?:licensed|released|available) under the elastic <l>(?:<v2(?:\.0)?>)?(?![\w.])
elastic | 3 | 0.8 | elastic | (?<!\w)elastic <l> 2\.0(?![\w.])
mulanpsl | 3 | 0.8 | mulan | (?<!\w)mulan (?:psl|permissive software <l>)(?!\w)
blueoak | 3 | 0.8 | blue oak | (?<!\w)blue oak model <l>(?!\w)
unicode | 3 | 0.8 | unicode | (?<!\w)unicode(?:, inc\.)? <l>(?: agreement)?(?!\w)
w3c | 3 | 0.8 | w3c | (?<!\w)w3c software (?:notice and )?<l>(?!\w)
jsonlic | 1 | 0.9 | evil | the software shall be used for good, not evil
beerware | 1 | 0.9 | beer-ware | "?the beer-ware <l>"?
ofl | 1 | 0.95 | open font | this font software is licensed under the sil open font <l>
ofl | 3 | 0.8 | open font | (?<!\w)(?:sil )?open font <l>(?:<v1\.[01]>)?(?![\w.])
odbl | 1 | 0.9 | open database | made available under the open database <l>
odbl | 3 | 0.8 | open database | (?<!\w)open database <l>(?!\w)
pddl | 3 | 0.8 | public domain dedication | (?<!\w)(?:odc )?public domain dedication and <l>(?!\w)
cdla | 3 | 0.8 | community data | (?<!\w)community data <l> agreement(?!\w)
cc0 | 1 | 0.95 | cc0|cc zero | (?:licen[sc]ed|released|distributed|published|available|dedicated) (?:under|with) (?:the )?(?:terms of )?(?:the )?(?:creative commons )?(?:cc0|cc zero)(?: 1\.0)?(?: universal)?(?!\w)
cc0 | 2 | 0.9 | cc0 | (?<!\w)(?:creative commons )?cc0 1\.0(?: universal)?(?!\w)
cc0 | 3 | 0.8 | cc0|cc zero | (?<!\w)(?:cc0|cc zero)(?: <l>| public domain dedication)?(?!\w)
cc-by-nc-nd | 2 | 0.9 | cc | (?<!\w)cc[- ]by[- ]nc[- ]nd(?:[ -][1-4]\.[05])?(?![\w-])
cc-by-nc-nd | 2 | 0.9 | creative commons | creative commons attribution[- ]non[- ]?commercial[- ]no[- ]?deriv(?:ative|ativework)?s?(?: [1-4]\.[05])?(?! ?\w*alike)
cc-by-nc-sa | 2 | 0.9 | cc | (?<!\w)cc[- ]by[- ]nc[- ]sa(?:[ -][1-4]\.[05])?(?![\w-])
cc-by-nc-sa | 2 | 0.9 | creative commons | creative commons attribution[- ]non[- ]?commercial[- ]share[- ]?alike(?: [1-4]\.[05])?
cc-by-nc | 2 | 0.9 | cc | (?<!\w)cc[- ]by[- ]nc(?:[ -][1-4]\.[05])?(?![\w-])(?! ?nd| ?sa)
cc-by-nc | 2 | 0.9 | creative commons | creative commons attribution[- ]non[- ]?commercial(?: [1-4]\.[05])?(?![- ](?:no|share))
cc-by-nd | 2 | 0.9 | cc | (?<!\w)cc[- ]by[- ]nd(?:[ -][1-4]\.[05])?(?![\w-])
cc-by-nd | 2 | 0.9 | creative commons | creative commons attribution[- ]no[- ]?derivatives(?: [1-4]\.[05])?
cc-by-sa | 2 | 0.9 | cc | (?<!\w)cc[- ]by[- ]sa(?:[ -][1-4]\.[05])?(?![\w-])
cc-by-sa | 2 | 0.9 | creative commons | creative commons attribution[- ]share[- ]?alike(?: [1-4]\.[05])?
cc-by | 2 | 0.9 | cc | (?<!\w)cc[- ]by(?:[ -][1-4]\.[05])?(?![\w-])(?! ?nc| ?nd| ?sa)
cc-by | 2 | 0.9 | creative commons | creative commons attribution(?: [1-4]\.[05])?(?: international| unported)?(?! ?[- ](?:non|no|share))
cc | 4 | 0.6 | creative commons | (?<!\w)creative commons <l>(?!\w)
openrail | 3 | 0.8 | openrail|rail | (?<!\w)(?:bigscience |creativeml )?(?:open ?rail|openrail)(?:-m|\+\+-m)?(?: <l>)?(?!\w)
bloom-rail | 3 | 0.8 | bigscience | (?<!\w)bigscience (?:bloom )?rail <l>(?!\w)
llama | 1 | 0.9 | llama | (?:licensed under|subject to) the (?:meta )?llama (?:[234](?:\.[0-9])? )?community <l>
llama | 3 | 0.8 | llama | (?<!\w)llama (?:[234](?:\.[0-9])? )?community <l>(?: agreement)?(?!\w)
gemma | 3 | 0.8 | gemma | (?<!\w)gemma (?:terms of use|<l>)(?!\w)
public-domain | 4 | 0.6 | public domain | (?<!\w)(?:in|into|to) the public domain(?!\w)
public-domain | 4 | 0.6 | public domain | (?<!\w)(?:dedicated|released|placed|donated) (?:to|into|in) the public domain(?!\w)
public-domain | 4 | 0.6 | public domain | (?<!\w)(?:is|are) public domain(?!\w)
proprietary | 5 | 0.5 | rights reserved | (?<!\w)all rights reserved(?!\w)
proprietary | 4 | 0.7 | proprietary | (?<!\w)proprietary and confidential(?!\w)
proprietary | 4 | 0.7 | prior written | without (?:the )?(?:express )?prior written (?:permission|consent) of
proprietary | 4 | 0.7 | end user | (?<!\w)end[- ]user <l> agreement(?!\w)
proprietary | 4 | 0.6 | trade secret | (?<!\w)trade secrets? of
noncommercial | 4 | 0.6 | non-commercial|noncommercial | (?<!\w)for non-?commercial (?:use|purposes) only(?!\w)
"""


def signatures() -> list[tuple[tuple[str, ...], str, str, int, float, re.Pattern]]:
    """(keywords, label, rule name, priority, weight, pattern) in the table's order."""
    made, seen = [], {}
    for line in filter(None, TABLE.split("\n")):
        label, priority, weight, rest = line.split(" | ", 3)
        keys, pattern = rest.rsplit(" | ", 1)
        seen[label] = seen.get(label, 0) + 1
        pattern = re.sub(r"<v((?:[^<>])+)>", r",? (?:\\(?v(?:ersion |\\. ?)?)?(?:\1)\\)?", pattern.replace("<l>", "licen[sc]e"))
        pattern = re.sub(r" (\?|\*)?", lambda m: r"\s" + (m[1].replace("?", "*") if m[1] else "+"), pattern)
        # White space may be a line's end, so a keyword's longest word stands for it.
        made.append((tuple(max(k.split(), key=len) for k in keys.split("|")), label, f"{label}/{seen[label]}", int(priority), float(weight), re.compile(pattern)))
    return made
