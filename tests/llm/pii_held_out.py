"""Labelled sentences that no training sees, in other words, numbers and names than the table's."""

SENTENCES = """
If the line is busy, call [phone 720-555-0188] instead.
The plumber's number is [phone 0113 496 0274], he works Sundays.
Phone: [phone (503) 555-0116].
Reach us at [phone 020 7946 0991] on weekdays.
Fax your form to [phone 312-555-0144] today.
Mobile [phone 07700 900822] is answered after six.
Tel. [phone 040/7654321] ist besetzt.
Telefon: [phone 0221 998877]
Appelez le [phone 03 22 33 44 55] avant midi.
Teléfono [phone 95 321 65 87] o por correo.
You may dial [phone 1-888-555-0123] at any hour.
The bank rang from [phone 212.555.0170] twice.
Her SSN, [id 318-44-7205], was leaked.
ssn [id 532-18-6640] belongs to a former employee
Social security number [id 401-77-1932] is required.
Tax ID [id 47-1122334] is missing.
Passport number [id 771203344] is invalid.
Mr. [name Gordon Blake] bought the farm.
Mrs. [name Ellen Hartley] and Dr. [name Samuel Ives] agreed.
Dear Ms. [name Farrow], your order has shipped.
My name is [name Rosa Delgado] and I need help.
Name: [name Stefan Wirth], Kassel.
Contact: [name Leila Nasser], desk 4.
Kind regards, [name Oscar Finch]
Frau [name Ingrid Moser] wartet unten.
Herr [name Weber] ist krank.
Monsieur [name Henri Colin] travaille ici.
Señora [name Marta Gil] no está.
Me llamo [name Diego Ramos] y soy médico.
Ich heiße [name Lena Kraus].
Attn: [name Bruno Costa], second floor.
Dear Mr. [name Adam Fisher], please phone [phone 555-0128].
Volume 9 runs to 720 pages and costs 48.90.
From 2010 to 2015 the rate fell by 3.5 points.
Release 10.4.2 came out on 2019-03-21.
Room 118, floor 3, building 7.
San Francisco and Mexico City host the games.
The Bank of England raised rates in June.
Order 9920-117 was split into 3 parcels.
The match ended 3-2 after 90 minutes.
ISBN 978-0-306-40615-7 was reprinted in 1998.
Page 12, line 40, column 8.
Dear friends, the hall opens at 19:30.
Der Zug 512 fährt um 14:05 von Gleis 9.
En 1936 el pueblo tenía 850 casas.
The phone rang 12 times in 2 hours.
""".strip().splitlines()
