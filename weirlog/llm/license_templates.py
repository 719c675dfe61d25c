"""Licence texts as templates.

Fixed values: the wording of common licences and notices. ``<<optional>>`` ... ``<<end>>``
marks wording that may be missing, ``<<any:N>>`` stands for up to N words of any
kind, everything else is mandatory. Case, punctuation and white space do not matter.
"""

#: Phrases that are counted wherever their words stand consecutively.
PHRASES = (
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
)


#: Notices and texts, each with the label that it gives.
TEMPLATES = (
    ("mit", "<<optional>>this work is<<end>> released under the <<optional>>terms of the<<end>> mit license"),
    ("mit", "licensed under the <<optional>>terms of the<<end>> mit license"),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of <<any:4>> software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice <<optional>>(including the next paragraph)<<end>> shall be
        included in all copies or substantial portions of the Software.""",
    ),
    (
        "apache-2.0",
        """Licensed under the Apache License, <<optional>>Version<<end>> 2.0""",
    ),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use <<any:4>> except in compliance
        with the License. You may obtain a copy of the License at""",
    ),
    ("gpl-3.0", "GNU General Public License, <<optional>>version<<end>> 3"),
    ("gpl-2.0", "GNU General Public License, <<optional>>version<<end>> 2"),
    ("agpl-3.0", "GNU Affero General Public License <<optional>>version<<end>> 3"),
    ("lgpl-3.0", "GNU Lesser General Public License <<optional>>version<<end>> 3"),
    ("lgpl-2.1", "GNU Lesser General Public License <<optional>>version<<end>> 2.1"),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the
        terms of the GNU General Public License as published by the Free Software Foundation, either version <<any:1>>
        of the License, or (at your option) any later version.""",
    ),
    (
        "bsd-2-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: <<any:1>> Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. <<any:1>> Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution.""",
    ),
    (
        "bsd-3-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: <<any:1>> Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. <<any:1>> Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution. <<any:1>> Neither the name of <<any:12>> nor the names of
        its contributors may be used to endorse or promote products derived from this software without specific prior
        written permission.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    ),
    (
        "mpl-2.0",
        """<<optional>>This Source Code Form is<<end>> subject to the terms of the Mozilla Public License, v. 2.0""",
    ),
    (
        "zlib",
        """Permission is granted to anyone to use this software for any purpose, including commercial applications, and
        to alter it and redistribute it freely, subject to the following restrictions""",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("bsl-1.0", "Boost Software License - Version 1.0"),
    ("cc0-1.0", "Creative Commons <<optional>>Legal Code<<end>> CC0 1.0 Universal"),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 International <<optional>>Public License<<end>>"),
    ("cc-by-sa-4.0", "Creative Commons Attribution ShareAlike 4.0 International <<optional>>Public License<<end>>"),
)
