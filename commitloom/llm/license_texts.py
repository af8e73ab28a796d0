"""Passages of public licence notices, label by label, and the base phrases.

The phrases and their labels are given; the passages are the customary wording
of the notices, of which a text shows a part.
"""

BASE_PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}

NOTICES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software "
        "and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute "
        "sublicense and or sell copies of the software",
        "released under the mit license",
    ),
    "apache-2": (
        "licensed under the apache license version 2 0 the license you may not use this file except in "
        "compliance with the license you may obtain a copy of the license at",
        "licensed under the apache license version 2 0",
    ),
    "gpl-3": (
        "this program is free software you can redistribute it and or modify it under the terms of the "
        "gnu general public license as published by the free software foundation either version 3 of "
        "the license or at your option any later version",
        "licensed under the gnu general public license version 3",
    ),
    "gpl-2": (
        "you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 2 of the license",
        "licensed under the gnu general public license version 2",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
    ),
    "mpl-2": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of "
        "the mpl was not distributed with this file you can obtain one at",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without "
        "fee is hereby granted",
    ),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license",),
    "cc-by-nc": (
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    ),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
}
