"""The licence signature table.

Patterns run over a text's normalised words: letters and digits in lower case with one space between words, so ``Apache-2.0`` reads
``apache 2 0``. A rule is tried only where one of its keywords occurs; every match holds one. ``KINDS`` orders the rules: a higher priority wins.
"""

from __future__ import annotations

#: kind -> (priority, confidence)
KINDS = {"text": (90, 0.99), "notice": (80, 0.95), "spdx": (70, 0.95), "url": (65, 0.9), "title": (60, 0.85), "family": (40, 0.7), "hint": (20, 0.4)}

#: kind | label | keyword, or several with slashes between | pattern
TABLE = r"""
text | mit | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
text | mit | the above copyright notice and this permission notice shall be included | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
text | bsd-2-clause | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted provided that the following (?:two )?conditions are met
text | bsd-3-clause | neither the name | neither the names? of .{1,80}? may be used to endorse or promote products derived from this software
text | bsd-4-clause | all advertising materials mentioning | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
text | isc | permission to use copy modify and | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
text | apache-2.0 | unless required by applicable law | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
text | gpl | this program is free software | this program is free software you can redistribute it and or modify it
text | gpl-2.0 | version 2 of the license | either version 2 of the license or at your option any later version
text | gpl-3.0 | version 3 of the license | either version 3 of the license or at your option any later version
text | lgpl | this library is free software | this library is free software you can redistribute it and or modify it
text | lgpl-2.1 | version 2 1 of the license | either version 2 1 of the license or at your option any later version
text | unlicense | free and unencumbered software | this is free and unencumbered software released into the public domain
text | wtfpl | what the fuck you want | you just do what the fuck you want to
text | zlib | in no event will the authors be held liable | this software is provided as is without any express or implied warranty in no event will the authors be held liable
text | boost-1.0 | person or organization obtaining | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
text | mpl-2.0 | this source code form is subject to | this source code form is subject to the terms of the mozilla public license v 2 0
text | epl-1.0 | this program and the accompanying materials | this program and the accompanying materials are made available under the terms of the eclipse public license v ?1 0
text | epl-2.0 | this program and the accompanying materials | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0
text | cddl-1.0 | common development and distribution license | the contents of this file are subject to the terms of the common development and distribution license
text | postgresql | without a written agreement is hereby granted | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
text | ntp | provided that the above copyright notice appears | for any purpose with or without fee is hereby granted provided that the above copyright notice appears in all copies
text | curl | permission to use copy modify and | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice(?=.{0,120} the software is provided as is without warranty of any kind)
text | ofl-1.1 | this font software is licensed | this font software is licensed under the sil open font license version 1 1
text | cc0-1.0 | waived all copyright | has waived all copyright and related or neighbou?ring rights to this work
text | json | shall be used for good not evil | the software shall be used for good not evil
text | beerware | you can do whatever you want with this stuff | as long as you retain this notice you can do whatever you want with this stuff
text | x11 | x consortium shall not be used | the name of the x consortium shall not be used in advertising
text | artistic-2.0 | artistic license 2 0 | this is free software licensed under the artistic license 2 0
text | proprietary | unauthorized copying | unauthorized copying of this file via any medium is strictly prohibited
text | proprietary | proprietary and / confidential and | (?:proprietary|confidential) and (?:proprietary|confidential|trade secrets?)
text | proprietary | no part of this | no part of this (?:publication|work|document|book) may be reproduced
notice | apache-2.0 | licensed under the apache license | licensed under the apache license version 2(?: 0)?
notice | apache-1.1 | apache | licensed under the apache (?:software )?license version 1 1
notice | apache-1.0 | apache | licensed under the apache (?:software )?license version 1 0
notice | mit | mit licen | (?:released|licensed|distributed|available|provided) under the (?:terms of the )?mit licen[sc]e
notice | mit | expat licen / mit licen / mit x11 licen | (?:released|licensed|distributed|available) under (?:the )?(?:expat|x11 mit|mit x11) licen[sc]e
notice | gpl-3.0 | gnu general public license | (?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?gnu general public license (?:as published by the free software foundation )?(?:either )?v(?:ersion)? ?3
notice | gpl-2.0 | gnu general public license | (?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?gnu general public license (?:as published by the free software foundation )?(?:either )?v(?:ersion)? ?2
notice | gpl-1.0 | gnu general public license | (?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?gnu general public license v(?:ersion)? ?1
notice | lgpl-3.0 | gnu lesser general public license | (?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?gnu lesser general public license v(?:ersion)? ?3
notice | lgpl-2.1 | gnu lesser general public license | (?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?gnu lesser general public license v(?:ersion)? ?2 1
notice | lgpl-2.0 | gnu library general public license | under (?:the terms of )?(?:the )?gnu library general public license v(?:ersion)? ?2
notice | agpl-3.0 | gnu affero general public license | (?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?gnu affero general public license v(?:ersion)? ?3
notice | cc-by-nc-4.0 | cc by nc | licensed under (?:a )?cc by nc (?:version )?4 0
notice | cc-by-nc-sa-4.0 | cc by nc sa | licensed under (?:a )?cc by nc sa (?:version )?4 0
notice | cc-by-nc-nd-4.0 | cc by nc nd | licensed under (?:a )?cc by nc nd (?:version )?4 0
notice | cc-by-sa-4.0 | cc by sa | licensed under (?:a )?cc by sa (?:version )?4 0
notice | cc-by-sa-3.0 | cc by sa | licensed under (?:a )?cc by sa (?:version )?3 0
notice | cc-by-nd-4.0 | cc by nd | licensed under (?:a )?cc by nd (?:version )?4 0
notice | cc-by-4.0 | cc by | licensed under (?:a )?cc by (?:version )?4 0
notice | cc-by-3.0 | cc by | licensed under (?:a )?cc by (?:version )?3 0
notice | cc-by-4.0 | creative commons attribution | (?:licensed|released|available) under (?:a |the )?creative commons attribution (?:international )?(?:licen[sc]e )?4 0
notice | cc-by-3.0 | creative commons attribution | (?:licensed|released|available) under (?:a |the )?creative commons attribution (?:unported )?(?:licen[sc]e )?3 0
notice | bsd-3-clause | bsd | (?:licensed|released|distributed|available) under the (?:terms of the )?(?:new|modified|revised|3 clause|three clause) bsd licen[sc]e
notice | bsd-2-clause | simplified / freebsd / 2 clause / two clause | (?:licensed|released|distributed|available) under the (?:terms of the )?(?:simplified|freebsd|2 clause|two clause) (?:bsd )?licen[sc]e
notice | bsd | bsd | (?:licensed|released|distributed|available) under the (?:terms of the )?bsd (?:style )?licen[sc]e
notice | mpl-2.0 | mozilla public license | (?:licensed|released|subject|available) (?:under|to) the (?:terms of the )?mozilla public license v(?:ersion)? ?2
notice | mpl-1.1 | mozilla public license | (?:licensed|released|subject|available) (?:under|to) the (?:terms of the )?mozilla public license v(?:ersion)? ?1 1
notice | epl-2.0 | eclipse public license | under the (?:terms of the )?eclipse public license (?:version |v )?2
notice | epl-1.0 | eclipse public license | under the (?:terms of the )?eclipse public license (?:version |v )?1
notice | isc | isc license | (?:licensed|released|available) under the (?:terms of the )?isc license
notice | zlib | zlib | (?:licensed|released|available) under the (?:terms of the )?zlib (?:libpng )?license
notice | boost-1.0 | boost software license | (?:distributed|licensed) under the boost software license version 1 0
notice | unlicense | unlicense | (?:licensed|released|dedicated) under the unlicense
notice | wtfpl | wtfpl | (?:licensed|released) under the wtfpl
notice | cc0-1.0 | cc0 | (?:licensed|released|dedicated) under (?:the )?cc0(?: 1 0)?
notice | artistic-2.0 | artistic license | (?:licensed|released) under the (?:terms of the )?artistic license (?:version )?2
notice | artistic-1.0 | artistic license | (?:licensed|released) under the (?:terms of the )?artistic license (?:version )?1
notice | perl | perl itself | under the same terms as perl itself
notice | ruby | ruby | under the same terms as ruby
notice | psf-2.0 | python software foundation license / psf license | under the (?:terms of the )?(?:python software foundation|psf) license
notice | php-3.01 | php license | subject to version 3 01 of the php license
notice | vim | vim license | under the (?:terms of the )?vim license
notice | odbl-1.0 | database license | under the (?:terms of the )?open (?:data commons )?(?:open )?database license
notice | odc-by-1.0 | open data commons attribution | under the (?:terms of the )?open data commons attribution license
notice | eupl-1.2 | eupl / european union public licen | under the (?:terms of the )?(?:eupl|european union public licen[sc]e)(?: v(?:ersion)? ?1 2)?
notice | cecill-2.1 | cecill | under the (?:terms of the )?cecill license
notice | openrail | openrail / open rail | under the (?:terms of the )?(?:creativeml |bigscience )?open ?rail(?: m| \+\+ m)? license
notice | llama | community license | under the (?:terms of the )?llama [0-9 ]{1,6}community license
notice | ms-pl | microsoft public license | under the (?:terms of the )?microsoft public license
notice | ms-rl | microsoft reciprocal license | under the (?:terms of the )?microsoft reciprocal license
notice | sspl-1.0 | server side public license | under the (?:terms of the )?server side public license
notice | busl-1.1 | business source license | under the (?:terms of the )?business source license
notice | elastic-2.0 | elastic license | under the (?:terms of the )?elastic license
notice | gfdl-1.3 | gnu free documentation license | under the (?:terms of the )?gnu free documentation license version 1 3
notice | gfdl-1.2 | gnu free documentation license | under the (?:terms of the )?gnu free documentation license version 1 2
notice | public-domain | public domain | (?:placed|released|dedicated|is) (?:in|into|to) the public domain
notice | open-government | open government licence | (?:licensed|available) under the open government licence
notice | proprietary | all rights reserved | copyright (?:c )?(?:[0-9]{4} )?.{0,80}?all rights reserved
spdx | mit | spdx | spdx license identifier mit
spdx | mit-0 | spdx | spdx license identifier mit 0
spdx | apache-2.0 | spdx | spdx license identifier apache 2 0
spdx | apache-1.1 | spdx | spdx license identifier apache 1 1
spdx | gpl-1.0 | spdx | spdx license identifier gpl 1 0(?: only| or later)?
spdx | gpl-2.0 | spdx | spdx license identifier gpl 2 0(?: only| or later)?
spdx | gpl-3.0 | spdx | spdx license identifier gpl 3 0(?: only| or later)?
spdx | lgpl-2.0 | spdx | spdx license identifier lgpl 2 0(?: only| or later)?
spdx | lgpl-2.1 | spdx | spdx license identifier lgpl 2 1(?: only| or later)?
spdx | lgpl-3.0 | spdx | spdx license identifier lgpl 3 0(?: only| or later)?
spdx | agpl-3.0 | spdx | spdx license identifier agpl 3 0(?: only| or later)?
spdx | bsd-2-clause | spdx | spdx license identifier bsd 2 clause
spdx | bsd-3-clause | spdx | spdx license identifier bsd 3 clause
spdx | bsd-4-clause | spdx | spdx license identifier bsd 4 clause
spdx | 0bsd | spdx | spdx license identifier 0bsd
spdx | isc | spdx | spdx license identifier isc
spdx | mpl-1.1 | spdx | spdx license identifier mpl 1 1
spdx | mpl-2.0 | spdx | spdx license identifier mpl 2 0
spdx | epl-1.0 | spdx | spdx license identifier epl 1 0
spdx | epl-2.0 | spdx | spdx license identifier epl 2 0
spdx | cddl-1.0 | spdx | spdx license identifier cddl 1 0
spdx | cc0-1.0 | spdx | spdx license identifier cc0 1 0
spdx | cc-by-4.0 | spdx | spdx license identifier cc by 4 0
spdx | cc-by-3.0 | spdx | spdx license identifier cc by 3 0
spdx | cc-by-sa-4.0 | spdx | spdx license identifier cc by sa 4 0
spdx | cc-by-sa-3.0 | spdx | spdx license identifier cc by sa 3 0
spdx | cc-by-nc-4.0 | spdx | spdx license identifier cc by nc 4 0
spdx | cc-by-nc-sa-4.0 | spdx | spdx license identifier cc by nc sa 4 0
spdx | cc-by-nc-nd-4.0 | spdx | spdx license identifier cc by nc nd 4 0
spdx | cc-by-nd-4.0 | spdx | spdx license identifier cc by nd 4 0
spdx | unlicense | spdx | spdx license identifier unlicense
spdx | wtfpl | spdx | spdx license identifier wtfpl
spdx | zlib | spdx | spdx license identifier zlib
spdx | boost-1.0 | spdx | spdx license identifier bsl 1 0
spdx | busl-1.1 | spdx | spdx license identifier busl 1 1
spdx | artistic-2.0 | spdx | spdx license identifier artistic 2 0
spdx | postgresql | spdx | spdx license identifier postgresql
spdx | psf-2.0 | spdx | spdx license identifier (?:psf|python) 2 0
spdx | eupl-1.2 | spdx | spdx license identifier eupl 1 2
spdx | ofl-1.1 | spdx | spdx license identifier ofl 1 1
spdx | odbl-1.0 | spdx | spdx license identifier odbl 1 0
spdx | gfdl-1.3 | spdx | spdx license identifier gfdl 1 3
spdx | sspl-1.0 | spdx | spdx license identifier sspl 1 0
spdx | elastic-2.0 | spdx | spdx license identifier elastic 2 0
spdx | ncsa | spdx | spdx license identifier ncsa
spdx | upl-1.0 | spdx | spdx license identifier upl 1 0
spdx | bluoak-1.0.0 | spdx | spdx license identifier blueoak 1 0 0
url | apache-2.0 | apache org licenses | apache org licenses license 2 0
url | mit | opensource org licenses | opensource org licenses mit(?: license)?
url | bsd-3-clause | opensource org licenses | opensource org licenses bsd 3 clause
url | bsd-2-clause | opensource org licenses | opensource org licenses bsd 2 clause
url | isc | opensource org licenses | opensource org licenses isc
url | artistic-2.0 | opensource org licenses | opensource org licenses artistic 2 0
url | gpl-3.0 | gnu org licenses | gnu org licenses gpl 3 0
url | gpl-2.0 | gnu org licenses | gnu org licenses (?:old licenses )?gpl 2 0
url | gpl | gnu org licenses | gnu org licenses gpl
url | lgpl-2.1 | gnu org licenses | gnu org licenses (?:old licenses )?lgpl 2 1
url | lgpl-3.0 | gnu org licenses | gnu org licenses lgpl 3 0
url | agpl-3.0 | gnu org licenses | gnu org licenses agpl 3 0
url | gfdl-1.3 | gnu org licenses | gnu org licenses fdl 1 3
url | mpl-2.0 | mozilla org mpl | mozilla org mpl 2 0
url | mpl-1.1 | mozilla org mpl | mozilla org mpl (?:mpl )?1 1
url | epl-2.0 | eclipse org | eclipse org legal epl 2 0
url | epl-1.0 | eclipse org | eclipse org legal epl v10
url | boost-1.0 | boost org license | boost org license 1 0 txt
url | unlicense | unlicense org | unlicense org
url | wtfpl | wtfpl net | wtfpl net
url | ofl-1.1 | scripts sil org ofl | scripts sil org ofl
url | cc-by-4.0 | creativecommons org licenses | creativecommons org licenses by 4 0
url | cc-by-3.0 | creativecommons org licenses | creativecommons org licenses by 3 0
url | cc-by-2.0 | creativecommons org licenses | creativecommons org licenses by 2 0
url | cc-by-sa-4.0 | creativecommons org licenses | creativecommons org licenses by sa 4 0
url | cc-by-sa-3.0 | creativecommons org licenses | creativecommons org licenses by sa 3 0
url | cc-by-nc-4.0 | creativecommons org licenses | creativecommons org licenses by nc 4 0
url | cc-by-nc-3.0 | creativecommons org licenses | creativecommons org licenses by nc 3 0
url | cc-by-nc-sa-4.0 | creativecommons org licenses | creativecommons org licenses by nc sa 4 0
url | cc-by-nc-nd-4.0 | creativecommons org licenses | creativecommons org licenses by nc nd 4 0
url | cc-by-nd-4.0 | creativecommons org licenses | creativecommons org licenses by nd 4 0
url | cc0-1.0 | creativecommons org publicdomain | creativecommons org publicdomain zero 1 0
url | public-domain | creativecommons org publicdomain | creativecommons org publicdomain mark 1 0
url | odbl-1.0 | opendatacommons org | opendatacommons org licenses odbl
url | eupl-1.2 | eupl | joinup ec europa eu .{0,60}?eupl
title | apache-2.0 | apache license | apache license (?:version |v )?2(?: 0)?
title | apache-1.1 | apache | apache (?:software )?license (?:version |v )?1 1
title | gpl-3.0 | gnu general public license | gnu general public license (?:version |v )?3
title | gpl-2.0 | gnu general public license | gnu general public license (?:version |v )?2
title | gpl-3.0 | gpl | gpl ?v?3(?: 0)?
title | gpl-2.0 | gpl | gpl ?v?2(?: 0)?
title | lgpl-2.1 | lgpl | lgpl ?v?2 1
title | lgpl-3.0 | lgpl | lgpl ?v?3
title | agpl-3.0 | agpl | agpl ?v?3
title | agpl-3.0 | affero | (?:gnu )?affero general public license (?:version |v )?3
title | cc-by-nc-sa-4.0 | cc by nc sa | cc by nc sa 4 0
title | cc-by-nc-nd-4.0 | cc by nc nd | cc by nc nd 4 0
title | cc-by-nc-4.0 | cc by nc | cc by nc 4 0
title | cc-by-nc-3.0 | cc by nc | cc by nc 3 0
title | cc-by-sa-4.0 | cc by sa | cc by sa 4 0
title | cc-by-sa-3.0 | cc by sa | cc by sa 3 0
title | cc-by-nd-4.0 | cc by nd | cc by nd 4 0
title | cc-by-4.0 | cc by | cc by 4 0
title | cc-by-3.0 | cc by | cc by 3 0
title | cc-by-2.0 | cc by | cc by 2 0
title | bsd-3-clause | bsd | (?:bsd 3 clause|3 clause bsd|new bsd license|modified bsd license)
title | bsd-2-clause | bsd | (?:bsd 2 clause|2 clause bsd|simplified bsd license|freebsd license)
title | mpl-2.0 | mozilla public license | mozilla public license (?:version |v )?2
title | mpl-1.1 | mozilla public license | mozilla public license (?:version |v )?1 1
title | epl-2.0 | eclipse public license | eclipse public license (?:version |v )?2
title | epl-1.0 | eclipse public license | eclipse public license (?:version |v )?1
title | cddl-1.0 | common development and distribution | common development and distribution license
title | isc | isc license | isc license
title | zlib | zlib license | zlib license
title | boost-1.0 | boost software license | boost software license
title | unlicense | unlicense | the unlicense
title | cc0-1.0 | cc0 | cc0 1 0 universal
title | ofl-1.1 | open font license | (?:sil )?open font license
title | mit-0 | mit no attribution | mit no attribution
title | ncsa | illinois | university of illinois ncsa open source license
title | upl-1.0 | universal permissive license | universal permissive license
title | wtfpl | do what the fuck | do what the fuck you want to public license
title | osl-3.0 | open software license | open software license (?:version |v )?3
title | afl-3.0 | academic free license | academic free license (?:version |v )?3
title | eupl-1.2 | eupl | eupl (?:v )?1 2
title | sspl-1.0 | server side public license | server side public license
title | busl-1.1 | business source license | business source license
title | bluoak-1.0.0 | blue oak | blue oak model license
family | gpl | gnu general public license | gnu general public license
family | lgpl | gnu lesser general public license | gnu lesser general public license
family | agpl | affero general public license | (?:gnu )?affero general public license
family | gfdl | gnu free documentation license | gnu free documentation license
family | apache | apache license | apache license
family | apache | apache software license | apache software license
family | mit | mit license | (?:the )?mit license
family | mit | expat license | expat license
family | cc-by-nc-sa | cc by nc sa | cc by nc sa
family | cc-by-nc-nd | cc by nc nd | cc by nc nd
family | cc-by-nc | cc by nc | cc by nc
family | cc-by-sa | cc by sa | cc by sa
family | cc-by-nd | cc by nd | cc by nd
family | cc-by | cc by | cc by
family | cc-by-nc-sa | creative commons attribution | creative commons attribution non ?commercial share ?alike
family | cc-by-nc | creative commons attribution | creative commons attribution non ?commercial
family | cc-by-sa | creative commons attribution | creative commons attribution share ?alike
family | cc-by | creative commons attribution | creative commons attribution
family | bsd | bsd license | bsd license
family | mpl | mozilla public license | mozilla public license
family | epl | eclipse public license | eclipse public license
family | artistic | artistic license | artistic license
family | eupl | european union public licen | european union public licen[sc]e
family | public-domain | public domain | public domain dedication
hint | other-license | license | see (?:the )?license (?:file )?for (?:more )?details
hint | other-license | licen | (?:licensed|released) under (?:the )?(?:[a-z0-9]+ ){1,5}?licen[sc]e
hint | copyright | copyright | copyright (?:c )?[12][0-9]{3}
hint | copyright | all rights reserved | all rights reserved
"""

#: A form -> the form that a later clause makes of it, told by text rules.
REFINED = {"bsd-2-clause": "bsd-3-clause"}

#: A document with none of these words has no rule to try.
ANCHORS = ("licen", "copyright", "permission", "redistribut", "spdx", "cc by", "cc0", "creative", "public domain", "gpl", "rights reserved", "free software", "unencumbered", "bsd", "eupl", "wtfpl", "warranty", "perl itself", "apache", "proprietary", "confidential", "opendatacommons", "same terms as ruby", "mozilla org", "eclipse org", "scripts sil org", "good not evil", "do whatever you want with this stuff", "consortium", "may be reproduced", "unauthorized copying", "acknowledg", "endorse or promote", "the fuck", "mit no")


def table() -> list[tuple[str, int, float, tuple[str, ...], str]]:
    """(label, priority, confidence, keywords, pattern) in order."""
    rows = (tuple(x.strip() for x in line.split(" | ")) for line in TABLE.strip().splitlines())
    return [(label, *KINDS[kind], tuple(keywords.split(" / ")), pattern) for kind, label, keywords, pattern in rows]
