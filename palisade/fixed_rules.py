"""Default rule base: the fixed search values of the detectors, as plain text.

One rule per line, in rule order.  Apart from SENSITIVE_PATHS (literal
substrings) every line is a regular expression.  A deployment with its own rule
base passes it as a parameter instead: see ``Rulebook.from_yaml``.
"""

# Fixed values. ------------------------------------------------------------------
# SENSITIVE_PATHS holds minimal substrings only: a path that contains a longer
# entry such as "/.git/config" also contains ".git", and the detector needs no
# more than the yes/no answer.

SENSITIVE_PATHS = r"""
.env
.git
.svn
.htaccess
.htpasswd
.DS_Store
.idea
.vscode
config.php
config.inc.php
config.ini
config.json
config.yml
database.yml
database.php
db.php
settings.php
settings.ini
credentials
secrets
composer.json
composer.lock
package.json
Gemfile
wp-config-sample.php
/wp-admin/upgrade.php
/wp-admin/includes
/wp-includes/version.php
/wp-content/backups
/wp-content/backup-db
/wp-content/plugins/akismet/akismet.php
/xmlrpc.php
/wp-json/wp/v2/users
/wp-login.php
/?author=1
/readme.html
/wp-trackback.php
/wp-cron.php
/dede
/data/common.inc.php
/data/config.cache.inc.php
/data/tag
/include/common.inc.php
/member/index.php
/member/reg_new.php
/plus/recommend.php
/plus/search.php
/plus/feedback.php
/plus/download.php
/plus/guestbook.php
/plus/diy.php
/plus/mytag_js.php
/plus/ad_js.php
/plus/carbuyaction.php
/install
/templets/default
/zb_system
/zb_users/c_option.php
/zb_users/data
/zb_users/plugin
/zb_users/upload
/data/zblog.db
/zblogphp.php
/usr/uploads
/usr/themes
/usr/plugins
/var/Typecho
/configuration.php
/joomla.xml
/language/en-GB/en-GB.xml
/libraries/joomla
/libraries/cms
/_files
/cache
/logs
/tmp
/index.php?c=admin
/index.php?s=admin
/dayrui
/api.php
/member.php
/D/extend
/e/data/html
/e/member
/e/public
/e/tool
/e/wap
/phpcms/libs/classes/config.class.php
/statics/js/ckeditor
/phpsso_server
/uc_server
/config/config_global.php
/config/config_ucenter.php
/uc_client/client.php
/utility
/api/manyou
/source/plugin
/sites/default/files
/update.php
/cron.php
/index.php?s=/Index/\\think\\app/invokefunction
/index.php?s=index/\\think\\request/input
/index.php?s=index/\\think\\Container/invokefunction
/index.php?s=captcha
/_runtime
/runtime
/thinkphp/library
/vendor/phpunit
/storage/framework/sessions
/artisan
/_debugbar
/telescope
/admin
/backend
/manage
/system
/console
/dashboard
/control
/cpanel
/webadmin
/siteadmin
/moderator
/phpmyadmin
/pma
/myadmin
/mysql
/db
/database
/sql
/actuator
/druid
/swagger
/api-docs
/graphql
/graphiql
/jenkins
/solr
/elasticsearch
/_cat/indices
/_nodes
/_cluster
/debug
/trace
/metrics
/monitor
/status
/server-status
/info.php
/phpinfo.php
/test.php
/i.php
/probe.php
.bak
.backup
.old
.orig
.save
.swp
.swo
~
.zip
.tar
.tgz
.rar
.7z
.sql
.dump
.mdb
.log
.txt
/shell
/cmd
/eval
/exec
c99.php
r57.php
webshell
/hack.php
/hacker.php
/1.php
/x.php
/xx.php
/a.php
/b.php
/tunnel.php
/tunnel.jsp
/.hg
/.bzr
/CVS/Root
/CVS/Entries
/nbproject
/Thumbs.db
/desktop.ini
"""

MALICIOUS_UA = r"""
sqlmap
nikto
nmap
masscan
zgrab
zmap
nessus
openvas
acunetix
netsparker
burpsuite
burp
owasp
w3af
dirbuster
dirb
gobuster
wfuzz
ffuf
feroxbuster
dirsearch
nuclei
httpx
subfinder
whatweb
webanalyze
wafw00f
wpscan
joomscan
droopescan
cmsmap
cmseek
wig
drupwn
hydra
medusa
patator
hashcat
john
brutex
scrapy
heritrix
HTTrack
WebCopier
WebZIP
Teleport
harvest
collector
havij
pangolin
safe3
jsql
sql power injector
^-$
^$
"""

SQL_INJECTION = r"""
union.*select
union.*all.*select
select.*from
select.*concat
select.*char
insert.*into
update.*set
delete.*from
drop.*table
drop.*database
truncate.*table
alter.*table
create.*table
'\s*or\s*'?1'?\s*=\s*'?1
"\s*or\s*"?1"?\s*=\s*"?1
'\s*or\s*'.*'\s*=\s*'
"\s*or\s*".*"\s*=\s*"
'\s*and\s*'.*'\s*=\s*'
"\s*and\s*".*"\s*=\s*"
or\s+1\s*=\s*1
or\s+1=1
and\s+1\s*=\s*1
and\s+1=1
'\s*or\s*true
'\s*or\s*false
sleep\s*\(
benchmark\s*\(
waitfor.*delay
pg_sleep
load_file\s*\(
into.*outfile
into.*dumpfile
load.*data.*infile
concat\s*\(
concat_ws\s*\(
group_concat\s*\(
char\s*\(
ascii\s*\(
ord\s*\(
hex\s*\(
unhex\s*\(
md5\s*\(
substr\s*\(
substring\s*\(
mid\s*\(
left\s*\(
right\s*\(
length\s*\(
count\s*\(
if\s*\(
ifnull\s*\(
nullif\s*\(
case.*when
0x[0-9a-fA-F]+
char\([0-9]+
%27
%22
%00
--\s*$
--\+
#\s*$
/\*.*\*/
/\*!
information_schema
mysql\.user
sys\.databases
master\.dbo
@@version
@@datadir
@@basedir
user\s*\(\s*\)
database\s*\(\s*\)
version\s*\(\s*\)
current_user
"""

XSS = r"""
<script
</script
<script.*>
<script.*src
javascript:
vbscript:
data:text/html
onerror\s*=
onload\s*=
onclick\s*=
onmouseover\s*=
onmouseout\s*=
onfocus\s*=
onblur\s*=
onchange\s*=
onsubmit\s*=
ondblclick\s*=
onkeydown\s*=
onkeyup\s*=
onkeypress\s*=
onmousedown\s*=
onmouseup\s*=
onmousemove\s*=
ondrag\s*=
ondrop\s*=
oncopy\s*=
oncut\s*=
onpaste\s*=
onscroll\s*=
oninput\s*=
onanimationend\s*=
ontransitionend\s*=
eval\s*\(
alert\s*\(
confirm\s*\(
prompt\s*\(
document\.cookie
document\.domain
document\.location
document\.write
document\.body
window\.location
window\.open
location\.href
location\.replace
innerHTML
outerHTML
insertAdjacentHTML
fromCharCode
String\.fromCharCode
<img.*onerror
<svg.*onload
<body.*onload
<iframe
<object
<embed
<applet
<meta.*http-equiv
<link.*href.*javascript
<base.*href
expression\s*\(
url\s*\(.*javascript
"""

PATH_TRAVERSAL = r"""
\.\./\.\.
\.\.\\
\.\./
\.\.\\
%2e%2e
%2e%2e/
%2e%2e%2f
%252e%252e
..%c0%af
..%c1%9c
..%255c
/etc/passwd
/etc/shadow
/etc/hosts
/etc/group
/etc/motd
/proc/self
/proc/version
/proc/cmdline
c:\windows
c:\boot.ini
c:\inetpub
windows/system32
windows/win.ini
boot\.ini
win\.ini
system32
\x00
%00
"""

COMMAND_INJECTION = r"""
;\s*cat\s
;\s*ls\s
;\s*dir\s
;\s*id\s*
;\s*whoami
;\s*pwd
;\s*uname
;\s*hostname
;\s*ifconfig
;\s*ipconfig
;\s*netstat
;\s*wget\s
;\s*curl\s
;\s*ping\s
;\s*nc\s
;\s*ncat\s
;\s*bash
;\s*sh\s
;\s*python
;\s*perl
;\s*ruby
;\s*php
\|\s*cat\s
\|\s*ls\s
\|\s*id\s
\|\s*bash
\|\s*sh\s
\|\s*wget
\|\s*curl
`.*`
\$\(.*\)
&&\s*cat
&&\s*ls
&&\s*id
&&\s*whoami
\|\|\s*cat
\|\|\s*ls
%0a
%0d
\n
\r
/bin/bash
/bin/sh
/usr/bin
cmd\.exe
powershell
command\.com
"""

FILE_INCLUSION = r"""
file=/etc
page=/etc
path=/etc
include=/etc
file=\.\.
page=\.\.
path=\.\.
include=\.\.
php://input
php://filter
php://data
phar://
expect://
zip://
data://
glob://
=http://
=https://
=ftp://
file=http
page=http
path=http
include=http
url=http
"""

SSRF = r"""
url=http://127
url=http://localhost
url=http://0\.0\.0\.0
url=http://\[::1\]
url=http://169\.254
url=http://10\.
url=http://172\.16
url=http://192\.168
url=file://
url=dict://
url=gopher://
url=ldap://
@127\.0\.0\.1
@localhost
%40127\.0\.0\.1
%40localhost
"""

XXE = r"""
<!ENTITY
<!DOCTYPE
SYSTEM\s+"file:
SYSTEM\s+"http:
SYSTEM\s+"https:
SYSTEM\s+"ftp:
SYSTEM\s+"php:
PUBLIC\s+
%xxe;
&xxe;
"""

SSTI = r"""
\{\{.*\}\}
\{%.*%\}
\$\{.*\}
#\{.*\}
<%.*%>
\{\{config\}\}
\{\{self\}\}
__class__
__mro__
__subclasses__
__globals__
__builtins__
__import__
"""

JAVA_DESERIALIZATION = r"""
rO0AB
aced0005
H4sIA
javax\.management
java\.lang\.Runtime
java\.lang\.ProcessBuilder
org\.apache\.commons\.collections
org\.springframework
com\.sun\.rowset
"""
