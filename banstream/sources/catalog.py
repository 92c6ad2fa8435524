"""The built-in rules: what a service writes to its log when a client fails.

A rule has a name, the log it is usually found in, the format of its dates and patterns with one ``<HOST>``.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Filter:
    group: str
    name: str
    log_path: str
    date_format: str
    patterns: tuple[str, ...]


# Names, paths, formats and patterns that results must agree on.
_RULES: dict[str, list[tuple[str, str, str, tuple[str, ...]]]] = {
    "auth": [
        (
            "dropbear",
            "/var/log/auth.log",
            "syslog",
            (
                r"dropbear\[\d+\].*[Bb]ad password attempt for .* from <HOST>:\d+",
                r"dropbear\[\d+\].*[Ll]ogin attempt for nonexistent user.*from <HOST>:\d+",
                r"dropbear\[\d+\].*[Ee]xit before auth.*from .?<HOST>:\d+",
            ),
        ),
        ("pam-generic", "/var/log/auth.log", "syslog", (r"pam_unix.*authentication failure;.* rhost=<HOST>",)),
        ("selinux-ssh", "/var/log/audit/audit.log", "epoch", (r"addr=<HOST>.*terminal=ssh.*res=failed",)),
        (
            "sshd",
            "/var/log/auth.log",
            "syslog",
            (
                r"sshd\[\d+\]: Failed password for .* from <HOST> port \d+",
                r"sshd\[\d+\]: Invalid user .* from <HOST> port \d+",
                r"sshd\[\d+\]: Connection closed by authenticating user .* <HOST> port \d+",
                r"sshd\[\d+\]: Disconnected from authenticating user .* <HOST> port \d+",
            ),
        ),
    ],
    "web": [
        (
            "apache-auth",
            "/var/log/apache2/error.log",
            "common",
            (
                r"client <HOST>.*user .* authentication failure",
                r"client <HOST>.*user .* not found",
                r"client <HOST>.*password mismatch",
            ),
        ),
        (
            "apache-botsearch",
            "/var/log/apache2/error.log",
            "common",
            (
                r"client <HOST>.*File does not exist:.*/(wp-login|xmlrpc|\.env|phpmyadmin)",
            ),
        ),
        ("apache-modsecurity", "/var/log/apache2/error.log", "common", (r"client <HOST>.*ModSecurity:.*Access denied with code [45]\d\d",)),
        ("apache-nohome", "/var/log/apache2/error.log", "common", (r"client <HOST>.*File does not exist:.*~",)),
        (
            "apache-noscript",
            "/var/log/apache2/error.log",
            "common",
            (
                r"client <HOST>.*script .* not found or unable to stat",
                r"client <HOST>.*File does not exist:.*\.php",
            ),
        ),
        ("apache-overflows", "/var/log/apache2/error.log", "common", (r"client <HOST>.*(?:Invalid (?:method|URI)|request failed:)",)),
        ("apache-shellshock", "/var/log/apache2/error.log", "common", (r"client <HOST>.*AH01215:.*(?:bash|sh):.*HTTP_",)),
        ("centreon", "/var/log/centreon/login.log", "iso8601", (r"\[<HOST>\] Authentication failed",)),
        ("directadmin", "/var/log/directadmin/login.log", "iso8601", (r"'<HOST>' \d+ failed login attempt",)),
        (
            "drupal",
            "/var/log/syslog",
            "syslog",
            (
                r"drupal.*Login attempt failed from <HOST>",
                r"(?:[^|]*\|){3}<HOST>\|.*Login attempt failed",
            ),
        ),
        ("froxlor-auth", "/var/log/syslog", "syslog", (r"Login Action <HOST>.*(?:Unknown user|wrong password)",)),
        ("gitlab", "/var/log/gitlab/gitlab-rails/application.log", "iso8601", (r"Failed Login:.*ip=<HOST>",)),
        (
            "grafana",
            "/var/log/grafana/grafana.log",
            "iso8601",
            (
                r"Invalid username or password.*remote_addr=<HOST>",
                r"User not found.*remote_addr=<HOST>",
            ),
        ),
        ("haproxy", "/var/log/haproxy.log", "syslog", (r"haproxy\[\d+\]: <HOST>:\d+ .*\b401\b",)),
        (
            "lighttpd-auth",
            "/var/log/lighttpd/error.log",
            "iso8601",
            (
                r"(?:password doesn.t match|digest: auth failed|get_password failed).* IP: <HOST>",
            ),
        ),
        (
            "monitorix",
            "/var/log/monitorix-httpd",
            "common",
            (
                r"NOTEXIST - \[<HOST>\]",
                r"AUTHERR - \[<HOST>\]",
                r"NOTALLOWED - \[<HOST>\]",
            ),
        ),
        ("nagios", "/var/log/syslog", "syslog", (r"Host <HOST> is not allowed to talk to us",)),
        (
            "nginx-auth",
            "/var/log/nginx/error.log",
            "common",
            (
                r"no user/password was provided for basic authentication.*client: <HOST>",
                r"user .* was not found.*client: <HOST>",
                r"user .* password mismatch.*client: <HOST>",
            ),
        ),
        ("nginx-bad-request", "/var/log/nginx/access.log", "common", (r'<HOST> - \S+ .+"[^"]*" 400 ',)),
        (
            "nginx-botsearch",
            "/var/log/nginx/access.log",
            "common",
            (
                r'<HOST> .* "(GET|POST) /(wp-login|xmlrpc|wp-admin|\.env|phpmyadmin|admin)',
            ),
        ),
        ("nginx-forbidden", "/var/log/nginx/error.log", "common", (r"access forbidden by rule, client: <HOST>,",)),
        (
            "nginx-limit-req",
            "/var/log/nginx/error.log",
            "common",
            (
                r"limiting requests, excess: .* by zone .*, client: <HOST>,",
                r"limiting connections by zone .*, client: <HOST>,",
                r"delaying request.* by zone .*, client: <HOST>,",
            ),
        ),
        ("openhab", "/var/log/openhab/request.log", "common", (r'<HOST>\s+-\s+.+\s+"[A-Z]+ .+" 401 ',)),
        ("php-url-fopen", "/var/log/apache2/access.log", "common", (r'<HOST> .*"(?:GET|POST).*\?.*=http://',)),
        ("phpmyadmin-syslog", "/var/log/auth.log", "syslog", (r"phpMyAdmin\[\d+\]: user denied: .* from <HOST>",)),
        (
            "squid",
            "/var/log/squid/access.log",
            "epoch",
            (
                r"\d\s+<HOST>\s+[A-Z_]+_DENIED/\d+",
                r"\d\s+<HOST>\s+NONE/405",
            ),
        ),
        ("suhosin", "/var/log/apache2/error.log", "common", (r"attacker '<HOST>'",)),
        ("traefik", "/var/log/access.log", "common", (r'<HOST> .*" 401 ',)),
        ("webmin-auth", "/var/log/auth.log", "syslog", (r"webmin\[\d+\]: (?:Invalid|Non-existent) login as .* from <HOST>",)),
        (
            "zoneminder",
            "/var/log/apache2/error.log",
            "common",
            (
                r"client <HOST>.*Login denied for user",
                r"client <HOST>.*Could not retrieve user .* details",
            ),
        ),
    ],
    "mail": [
        ("courier-auth", "/var/log/mail.log", "syslog", (r"LOGIN FAILED,.* ip=\[<HOST>\]",)),
        ("courier-smtp", "/var/log/mail.log", "syslog", (r"courieresmtpd.*error,relay=<HOST>,",)),
        ("cyrus-imap", "/var/log/mail.log", "syslog", (r"badlogin:.*\[<HOST>\].*SASL\(-13\)",)),
        (
            "domino-smtp",
            "/local/notesdata/IBM_TECHNICAL_SUPPORT/console.log",
            "common",
            (
                r"connecting host <HOST>",
                r"smtp.*\[<HOST>\] authentication failure",
            ),
        ),
        (
            "dovecot",
            "/var/log/mail.log",
            "syslog",
            (
                r"dovecot: .*auth failed.*rip=<HOST>",
                r"dovecot: .*Aborted login.*rip=<HOST>",
            ),
        ),
        ("exim", "/var/log/exim4/mainlog", "iso8601", (r"authenticator failed for.*\[<HOST>\].*535 Incorrect authentication",)),
        ("groupoffice", "/var/log/groupoffice.log", "iso8601", (r"LOGIN FAILED.*IP: <HOST>",)),
        ("horde", "/var/log/horde/horde.log", "syslog", (r"HORDE.*FAILED LOGIN for \S+ \[<HOST>\]",)),
        (
            "kerio",
            "/var/log/kerio/mail.log",
            "common",
            (
                r"SMTP Spam attack detected from <HOST>,",
                r"IP address <HOST>",
            ),
        ),
        ("openwebmail", "/var/log/openwebmail.log", "common", (r"\(<HOST>\).*(?:login error|userinfo error)",)),
        ("oracleims", "/var/log/oracleims/mail.log", "iso8601", (r'\|<HOST>\|\d+".*mi="Bad password"',)),
        (
            "perdition",
            "/var/log/mail.log",
            "syslog",
            (
                r"perdition.*Auth: <HOST>:\d+.*status=.failed",
                r"perdition.*Fatal Error reading authentication.*client <HOST>:\d+",
            ),
        ),
        (
            "postfix",
            "/var/log/mail.log",
            "syslog",
            (
                r"postfix/smtpd\[\d+\]: warning: .*\[<HOST>\]: SASL .* authentication failed",
                r"postfix/smtpd\[\d+\]: NOQUEUE: reject: RCPT from .*\[<HOST>\]",
            ),
        ),
        (
            "qmail",
            "/var/log/mail.log",
            "syslog",
            (
                r"rblsmtpd: <HOST>",
                r"badiprbl: ip <HOST>",
            ),
        ),
        (
            "roundcube-auth",
            "/var/log/roundcubemail/errors",
            "iso8601",
            (
                r"(?i)login failed for .* from <HOST>",
                r"(?i)failed login for .* from <HOST>",
            ),
        ),
        ("sendmail-auth", "/var/log/mail.log", "syslog", (r"\[<HOST>\]: possible SMTP attack: command=AUTH",)),
        ("sieve", "/var/log/mail.log", "syslog", (r"badlogin:.*\[<HOST>\].*authentication failure",)),
        ("sogo-auth", "/var/log/sogo/sogo.log", "syslog", (r"SOGoRootPage Login from '<HOST>.*might not have worked",)),
        ("solid-pop3d", "/var/log/mail.log", "syslog", (r"solid-pop3d\[\d+\]: authentication failed:.* - <HOST>",)),
        ("squirrelmail", "/var/lib/squirrelmail/prefs/squirrelmail_access_log", "common", (r"from <HOST>: Unknown user or password incorrect",)),
        ("tine20", "/var/log/tine20/tine20.log", "iso8601", (r"Login with username .* from <HOST> failed",)),
        ("uwimap-auth", "/var/log/mail.log", "syslog", (r"Login failed user=.* \[<HOST>\]",)),
    ],
    "ftp": [
        ("gssftpd", "/var/log/auth.log", "syslog", (r"ftpd\[\d+\]: repeated login failures from <HOST>",)),
        (
            "proftpd",
            "/var/log/auth.log",
            "syslog",
            (
                r"proftpd\[\d+\].*?\([^\[]+\[<HOST>\]\).*Login failed",
                r"proftpd\[\d+\].*?\([^\[]+\[<HOST>\]\).*no such user",
                r"proftpd\[\d+\].*?\([^\[]+\[<HOST>\]\).*Incorrect password",
                r"proftpd\[\d+\].*?\([^\[]+\[<HOST>\]\).*SECURITY VIOLATION",
                r"proftpd\[\d+\].*?\([^\[]+\[<HOST>\]\).*Maximum login attempts",
            ),
        ),
        ("pure-ftpd", "/var/log/auth.log", "syslog", (r"pure-ftpd: \(.+?@<HOST>\) \[WARNING\]",)),
        ("vsftpd", "/var/log/vsftpd.log", "syslog", (r'vsftpd.*FAIL LOGIN: Client "<HOST>"',)),
        ("wuftpd", "/var/log/auth.log", "syslog", (r"wu-ftpd\[\d+\]: failed login from .* \[<HOST>\]",)),
    ],
    "db": [
        ("mssql-auth", "/var/opt/mssql/log/errorlog", "iso8601", (r"Login failed for user .*\[CLIENT: <HOST>\]",)),
        (
            "mysqld",
            "/var/log/mysql/error.log",
            "iso8601",
            (
                r"Access denied for user .*@'<HOST>'",
                r"Access denied for user .* from '<HOST>'",
            ),
        ),
    ],
    "vpn": [
        (
            "openvpn",
            "/var/log/syslog",
            "syslog",
            (
                r"ovpn-.* <HOST>:\d+ TLS Auth Error",
                r"ovpn-.* <HOST>:\d+.*AUTH_FAILED",
            ),
        ),
        ("softethervpn", "/usr/local/vpnserver/security_log/DEFAULT/sec.log", "iso8601", (r"User authentication failed.* from <HOST>",)),
    ],
    "voip": [
        (
            "asterisk",
            "/var/log/asterisk/messages",
            "iso8601",
            (
                r"NOTICE.* <HOST> failed to authenticate",
                r'SECURITY.* SecurityEvent="FailedACL".*RemoteAddress.*<HOST>',
            ),
        ),
        (
            "freeswitch",
            "/var/log/freeswitch/freeswitch.log",
            "iso8601",
            (
                r"SIP auth (?:failure|challenge).* from ip <HOST>",
                r"Can.t find user .* from <HOST>",
            ),
        ),
        (
            "murmur",
            "/var/log/mumble-server/mumble-server.log",
            "iso8601",
            (
                r"Rejected connection from <HOST>:\d+: (?:Invalid server password|Wrong certificate)",
            ),
        ),
    ],
    "misc": [
        ("3proxy", "/var/log/3proxy.log", "common", (r"PROXY\.\d+ \d{3}0[1-9] \S+ <HOST>:\d+",)),
        ("bitwarden", "bwdata/logs/identity/log.txt", "iso8601", (r"Failed login attempt.* <HOST>",)),
        ("counter-strike", "/opt/cstrike/logs/L0101000.log", "common", (r'Bad Rcon:.*from "<HOST>:\d+"',)),
        ("guacamole", "/var/log/guacamole.log", "iso8601", (r"Authentication attempt from <HOST> for user .* failed",)),
        (
            "monit",
            "/var/log/monit.log",
            "syslog",
            (
                r"Client .?<HOST>.? supplied wrong password",
                r"Client .?<HOST>.? supplied unknown user",
            ),
        ),
        ("named-refused", "/var/log/syslog", "syslog", (r"named\[\d+\].*client <HOST>#\d+.*(?:denied|REFUSED)",)),
        ("netfilter-portscan", "/var/log/kern.log", "syslog", (r"kernel: .*IN=\S+ .*SRC=<HOST> DST=\S+ .*PROTO=",)),
        (
            "nsd",
            "/var/log/nsd.log",
            "epoch",
            (
                r"nsd\[\d+\]: info: ratelimit block .* query <HOST>",
                r"nsd\[\d+\]:.*from client <HOST> refused",
            ),
        ),
        (
            "pf-portscan",
            "/var/log/pf.log",
            "syslog",
            (
                r"block in on \S+:\s+<HOST>\.\d+ >",
                r"block in on \S+:\s+<HOST> >",
            ),
        ),
        (
            "pfsense-portscan",
            "/var/log/filter.log",
            "syslog",
            (
                r"filterlog\[\d+\]: .*,block,in,4,(?:[^,]*,){9}<HOST>,",
                r"filterlog\[\d+\]: .*,block,in,6,(?:[^,]*,){6}<HOST>,",
            ),
        ),
        ("portsentry", "/var/lib/portsentry/portsentry.history", "epoch", (r"/<HOST> Port: \d+ (?:TCP|UDP) Blocked",)),
        ("proxmox", "/var/log/daemon.log", "syslog", (r"pvedaemon\[.*authentication failure; rhost=<HOST>",)),
        ("routeros-auth", "/var/log/routeros.log", "syslog", (r"system,error,critical login failure for user .* from <HOST> via",)),
        ("scanlogd", "/var/log/syslog", "syslog", (r"scanlogd: <HOST> to",)),
        ("screensharingd", "/var/log/system.log", "syslog", (r"screensharingd\[\d+\]: Authentication: FAILED.*Viewer Address: <HOST>",)),
        (
            "stunnel",
            "/var/log/stunnel.log",
            "iso8601",
            (
                r"SSL_accept from <HOST>:\d+ :.*SSL routines.*peer did not return a certificate",
            ),
        ),
        (
            "vaultwarden",
            "/var/log/vaultwarden.log",
            "iso8601",
            (
                r"Username or password is incorrect.*IP: <HOST>",
                r"Invalid admin token.*IP: <HOST>",
                r"Invalid TOTP code.*IP: <HOST>",
            ),
        ),
        ("xinetd-fail", "/var/log/syslog", "syslog", (r"FAIL:.*from=<HOST>",)),
        ("xrdp", "/var/log/xrdp-sesman.log", "iso8601", (r"AUTHFAIL: user=\S+ ip=<HOST>",)),
        ("znc-adminlog", "/var/lib/znc/moddata/adminlog/znc.log", "iso8601", (r"failed to login from <HOST>",)),
    ],
}

FILTERS: dict[str, Filter] = {rule[0]: Filter(group, *rule) for group, rules in _RULES.items() for rule in rules}
