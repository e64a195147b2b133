"""The labelled table that the field of :mod:`pii` is trained from: sentences, entities in brackets behind their kind.

Written for this purpose; all persons and numbers are invented.
"""

SENTENCES = """
Please call [phone 555-201-8834] before noon on Friday.
You can reach the office at [phone (212) 555-0187] or by mail.
Our new telephone number is [phone 020 7946 0018], effective immediately.
For bookings ring [phone 0161 496 0733] between 9 and 5.
Mobile: [phone 07700 900461], home: [phone 01632 960983].
Fax [phone 212-555-0163], attention accounts.
Text me at [phone 415.555.0139] when you land.
My cell is [phone 303 555 0125] if anything comes up.
Customer service: [phone 800-555-0199] (toll free).
He left a message from [phone 617-555-0108] last night.
Contact the landlord on [phone 0117 496 0902] about the boiler.
Tel: [phone 030/2345678], Fax: [phone 030/2345679].
Telefon [phone 089 1234567], Montag bis Freitag.
Rufen Sie uns an unter [phone 0711/9876543].
Appelez le [phone 01 44 55 66 77] pour un rendez-vous.
Mon numéro est le [phone 06 12 34 56 78], merci.
Llame al [phone 91 234 56 78] para reservar mesa.
Teléfono: [phone 93 456 78 90], horario de oficina.
Whatsapp [phone 600 123 456] para pedidos.
Dial [phone 1-800-555-0142] and ask for billing.
The helpdesk, phone [phone 555 0147], closes at six.
In an emergency phone [phone 555-0190] at once.
Her direct line is [phone 646-555-0111], extension 12.
Call the clinic ([phone 541-555-0167]) to cancel.
Pager [phone 555-0104] or desk [phone 555-0105].
The applicant gave social security number [id 078-05-1120] on the form.
SSN: [id 219-09-9999], verified in March.
His SSN is [id 457-55-5462], do not share it.
Employee [name Dana Whitfield], ssn [id 123-45-6789], starts Monday.
Tax ID [id 12-3456789] appears on the invoice.
EIN [id 98-7654321] was issued in Ohio.
National insurance number [id QQ 12 34 56 C] on file.
NI number: [id AB 65 43 21 D], please confirm.
Passport no. [id 533380006] expires next year.
Passport number [id 925076473] was reported lost.
Her passport, number [id 483920156], is at the consulate.
Driver licence [id 99-123-4567] was copied at the desk.
Identity card [id 384-19-2217] belongs to the tenant.
Patient [name Luis Ortega], insurance id [id 552-31-9087], was discharged.
Taxpayer number [id 900-70-1234] could not be matched.
The number [id 301-22-4418] is printed on the card, ssn of the holder.
Personal id [id 640-11-2093] missing from the record.
Mr. [name Edward Thornton] signed for the parcel.
Mrs. [name Ana Lindqvist] will chair the session.
Dear Ms. [name Okafor], thank you for your letter.
Dear Mr. [name Peter Vance], we regret to inform you.
Dr. [name Helen Marsh] examined the patient on Tuesday.
Prof. [name Ivo Kranjec] gave the opening lecture.
My name is [name Carla Benedetti] and I live in Turin.
My name is [name Tom Whitaker].
Name: [name Jonas Feld], age 41, Bremen.
Name: [name Marie Dubois]
Contact: [name Sarah Connelly], room 214.
Contact [name Ravi Menon] or [name Julia Stone] for access.
Signed, [name Arthur Pell], treasurer.
Yours sincerely, [name Margaret Doyle]
Kind regards, [name Felix Brandt]
Best regards, [name Noor Hassan], support team
Regards, [name Tim Cole]
I am [name Petra Novak], the new tenant.
This is [name Daniel Cho] speaking.
Herr [name Klaus Berger] kommt um acht.
Frau [name Sabine Vogel] hat angerufen.
Sehr geehrte Frau [name Keller], vielen Dank.
Sehr geehrter Herr [name Lorenz Huber], anbei die Rechnung.
Monsieur [name Paul Girard] est absent.
Madame [name Claire Fontaine] vous attend.
Cher Monsieur [name Lambert], merci beaucoup.
Señor [name Javier Molina] llegó tarde.
Señora [name Lucía Prado] firmó el contrato.
Estimado Sr. [name Rubén Salas], gracias por su carta.
Me llamo [name Elena Torres] y vivo en Sevilla.
Je m'appelle [name Luc Moreau] et j'ai trente ans.
Ich heiße [name Anna Schmitt] und wohne in Kiel.
Nombre: [name Pablo Rey], edad 33.
Nom: [name Camille Roux], ville Lyon.
The tenant, Mr [name Victor Hale], phoned from [phone 555-0172].
Ask for Miss [name Joan Pryor] at [phone 555-0133].
Attn: [name Gloria Mendes], third floor.
Sender: [name Hugo Lang], Basel.
Customer [name Irene Walsh] asked for a refund.
Patient [name Omar Haddad] was admitted at 10:40.
Chapter 12 covers pages 340 to 512 of the second edition.
Version 4.12.0 was released on 2021-07-14 with 38 fixes.
The budget rose from 1,250,000 to 1,400,000 in 2019.
Between 1914 and 1918 the river froze 3 times.
ISBN 978-3-16-148410-0 is out of print.
Order 4471-228-90 shipped on 03/11/2022 in 2 boxes.
The score was 21-14 after 60 minutes.
Invoice 2020-0045 totals 312.50 plus 19 % tax.
Flight 447 leaves at 18:35 from gate 22.
Postcode 90210 and area 310 are often confused.
Part 555-0147 fits models 200, 300 and 400.
Section 3.2.1 replaces section 3.1 of the 2004 manual.
Coordinates 48.2082, 16.3738 mark the square.
Total 100 200 300 400 in the four columns.
Serial 12-3456-789 is engraved on the back.
The ratio 3 to 1 held in 12 of 15 trials.
New York and Los Angeles grew by 2 percent.
The Royal Society of London met on Thursday.
Monday, Tuesday and Wednesday are full.
In April The Guardian reported from Cape Town.
He read War and Peace on the Trans Siberian Railway.
Dear customers, we close early on Christmas Eve.
The name of the rose is a riddle.
Doctor visits cost more in January than in May.
Regards from the whole team.
Call the helpdesk before you reboot.
A number of people phoned about the parcel.
Mr. and Mrs. are titles.
Contact us on our website for details.
My name is on the list already.
This is London calling.
The ssn field must not be empty.
Passport control took 45 minutes in 2018.
Tax rates of 12 and 22 percent apply.
Signed copies cost 25 dollars.
Le 14 juillet 1789 est une date connue.
Am 3. Oktober 1990 um 0 Uhr war es soweit.
El 12 de octubre de 1492 llegaron tres barcos.
Seit 2005 leben 120 Familien in der Stadt.
Tome 3, pages 210 à 245, Paris 1862.
Kapitel 7 und 8 sind 40 Seiten lang.
Hay 1200 alumnos en 48 clases.
""".strip().splitlines()
