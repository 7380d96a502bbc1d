"""Labelled lines for the personal-data model, made up for it.

{kind:text} marks a span; each # stands for a digit drawn anew for every copy
of a line, and ~ for the check digit of a card number.  Lines without marks
hold what only looks like personal data.
"""

LINES = """
Call {phone:(###) 555-####} before noon.
Phone: {phone:###-555-####}, ask for Mary.
tel. {phone:0## #### ####} or write to us
Tel {phone:0#### ######} (office hours)
You can reach me at {phone:(###)###-####} today
Fax {phone:0#-##-##-##-##} et courrier
Téléphone : {phone:0# ## ## ## ##} le matin
Appelez le {phone:0#.##.##.##.##} avant midi
Telefon {phone:0## / #######} ab neun Uhr
Rufen Sie {phone:0###/######} an, bitte
Mobil: {phone:01## #######} oder abends
Llame al {phone:9## ## ## ##} por la tarde
teléfono {phone:6##-###-###} de contacto
mobile {phone:07### ######} any time
her number is {phone:### ### ####} I think
whatsapp {phone:00## ## ### ####} only
Phone {phone:00 1 ### 555 ####} from abroad
dial {phone:1-###-555-####} toll free
dial {phone:1 (###) 555-####} extension two
(tel: {phone:###.###.####})
call me, {phone:(0##) ####-####}, or Ann, {phone:(0##) ####-####}
Phones {phone:###-555-####} / {phone:###-555-####}
call {phone:+1 (###) 555-####} 1##.2#.#.1## next
at {phone:+1 (###) 555-####} 12#.1##.2#.# or later
dial {phone:+44 20 #### ####} 1##.1#.##.# now
{phone:+33 1 ## ## ## ##} 8#.1##.2##.# est pris
téléphonez au {phone:0# ## ## ## ##} svp
le numéro est {phone:0#.##.##.##.##} ou bien {phone:0# ## ## ## ##}
numéro de téléphone {phone:0#-##-##-##-##}.
teléfono {phone:9## ### ###} y {phone:6## ### ###}
llamar al {phone:9# ### ## ##} de nueve a dos
móvil: {phone:6## ## ## ##}
teléfono {phone:9# ### ## ##} oficina
unter {phone:0## ### ## ##} zu erreichen
Tel.: {phone:0##-########}
office {phone:(0###) ### ####} daily
phone {phone:0### ### ####} please
contact {phone:(###) ###-####}; mail {email:anna.ray (at) example.org}
Write to {email:john.doe (at) example.com} soon.
mail: {email:jane[at]example[dot]org}
e-mail {email:info [at] example [dot] net} for more
my address is {email:bob at example dot com} and I answer
Contact {email:mary.jones at mail dot example dot org} please
kontakt: {email:max.muster(at)example.de}
E-Mail {email:buero (at) beispiel (dot) de} oder Post
courriel {email:jean.dupont (arobase) exemple (point) fr}
écrire à {email:marie [at] exemple.fr} avant lundi
correo {email:ana.lopez (arroba) ejemplo.es} hoy
escriba a {email:info arroba ejemplo punto es} ya
ping {email:dev-team{at}example{dot}io} first
send it to {email:sales @ example.com} today
send it to {email:j_smith AT example DOT com} today
{email:user##(at)mail#.example.com} wrote last week
from {email:user##[at]mail#[dot]example[dot]com} again
Server {ip:10[.]##[.]#[.]2#} was down
the host {ip:192[.]168[.]#[.]4#} answered
blocked {ip:1##[dot]2#[dot]1##[dot]7} today
IP {ip:1## . 1## . # . ##} seen
traffic from {ip:8#(.)1##(.)2#(.)9} dropped
address {ip:10 dot ## dot # dot ##} in the log
see {ip:1##[.]#[.]#[.]#} there
{ip:##[.]##[.]##[.]##} and {ip:1##[.]1##[.]#[.]#} are bad
ssh {ip:10[.]#[.]#[.]1##} fails
Card {card:4### #### #### ###~} expires soon -> card {card:4###.####.####.###~} again
credit card {card:5###/####/####/###~} was used
Karte {card:4###.####.####.###~} gesperrt
carte {card:4###_####_####_###~} volée
tarjeta {card:5###.####.####.###~} perdida
visa no. {card:4###  ####  ####  ###~} on file
paid with {card:3### . ###### . ####~} in May
Order ################ was sent.
the code ################ is old
number ################ and ################ too
token = "a#b##c###d####e#####f######7a"
On 20##-0#-1# at 1#:## we met
from 1#.0#.20## to 2#.0#.20## only
between 19## and 20## about #### people
ISBN 978-#-##-######-# is out of print
isbn 978#########1 second edition
the ISBN #-###-#####-# and #-####-####-#
ISBN: 0-##-######-# (paper)
item #-####-## of list ##-####
part ##-###-####-## and part 0#-###-####-##
form ##-####/# or ##.###.####
account 0#-##-####-## was closed
a price of # ### ### euros and ##.### more
version #.##.#.## of the tool, build ######
see section #.#.#.#.# for more
lat 5#.0######, lon -1.3######
invoice no. ####-####-#### of March
Rechnung Nr. ########## vom Mai
order id ###-#######-####### shipped
commande n° ######### du mois
pedido ########## enviado
scores were #-#, #-#, #-# and ##-##
rows: ### ### ### ### ### ### ###
| ## | ### | #### | ### | ## |
1 2 3 4 5 6 7 8 9 10 11 12 13
part ##-###-####-## is in stock
model ####/##/#### and size ##x##x##
timestamp ########## was logged
phase #: ##### units, ##### units
page ### of ####, 0#/0#/20##
ratio ##:##:##:## and ####:####
the cat sat at home. Dot came later
look at example.com for more
meet me at noon dot dot dot
it was at noon.Then we left
stay at home.Nobody came, he said
we looked at them . They were at ease
seen at index.html and at setup.py today
we stood at the door at point two
at the dot of nine they left
a (at) b and c are fine
read it at docs.example.org or at home
he was at ## High Street at ##:##
serial ####-####-####-####-#### on the back
""".strip().split("\n")
